"""Caption tracks of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def picked(tracks: DataFrame, video: str = "video_id", order: str = "track_idx") -> DataFrame:
    """One track a video: `en`, else `en-orig`, else another `en...`, else the first."""
    lang = F.coalesce("lang", F.lit(""))
    rank = F.when(lang == "en", 0).when(lang == "en-orig", 1).when(F.startswith(lang, F.lit("en")), 2).otherwise(3)
    w = W.partitionBy(video).orderBy(rank, order)
    return tracks.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def fetch_captions(tool, url: str, stamp: str) -> dict:
    """A dict (snapshot or None, error or None) of a video's captions by an injected tool: `metadata(url)` and `captions(url)` -> [(lang, vtt)]."""
    import hashlib
    import re

    if tool is None:
        return {"snapshot": None, "error": {"kind": "dependency-missing", "message": "no caption tool is given"}}
    try:
        meta, tracks = tool.metadata(url), tool.captions(url)
    except Exception as e:
        return {"snapshot": None, "error": {"kind": "adapter-error", "message": str(e)}}
    if not tracks:
        return {"snapshot": None, "error": {"kind": "adapter-error", "message": f"{url} has no captions"}}

    def rank(k: int) -> tuple[int, int]:
        lang = tracks[k][0] or ""
        return (0 if lang == "en" else 1 if lang == "en-orig" else 2 if re.match("en", lang) else 3, k)

    lang, vtt = tracks[min(range(len(tracks)), key=rank)]
    body_hash = hashlib.sha256(vtt.encode()).hexdigest()
    shot = {"source_id": str(meta.get("id")), "url": url, "fetched_at": stamp, "status": 200, "content_type": "transcript", "body": vtt, "body_hash": body_hash}
    return {"snapshot": shot, "error": None, "metadata": meta | {"lang": lang}}


def tool_line(line: str) -> dict:
    """The tab-separated line that a caption tool prints: id, title, channel, duration in seconds."""
    parts = (line.rstrip("\n").split("\t") + [""] * 4)[:4]
    return {"id": parts[0], "title": parts[1], "channel": parts[2], "duration": int(float(parts[3])) if parts[3].replace(".", "", 1).isdigit() else None}
