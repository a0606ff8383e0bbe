"""Polite fetching: one task per origin, with an injected client.

A client is any callable of (url, headers, timeout_ms) that returns a dict (status, headers, body or bytes) or raises; time, waiting and chance are
injected too, so that a test or a replay is exact. All sources of an origin go through one task, in order, and keep its minimum delay.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.urls import origin

REDIRECTS, RETRIES, MOST_RETRIES, BACKOFF_MS, DELAY_MS, TIMEOUT_MS = 5, 2, 5, 250, 1000, 15_000
AGENT = "gristmill/0.1"


class FetchError(Exception):
    def __init__(self, kind: str, message: str, status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status


@dataclass
class Clock:
    now: Callable[[], float] = lambda: time.time() * 1000
    sleep: Callable[[float], None] = lambda ms: time.sleep(ms / 1000)
    draw: Callable[[], float] = random.random
    stamp: Callable[[], str] = lambda: time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime())


@dataclass
class Session:
    """What a task knows of its origins: robots rules and when each was last asked."""

    client: Callable
    clock: Clock = field(default_factory=Clock)
    renderer: Callable | None = None
    robots: dict[str, list[tuple[str, bool]]] = field(default_factory=dict)
    asked: dict[str, float] = field(default_factory=dict)


def robots_rules(body: str, agent: str) -> list[tuple[str, bool]]:
    """The rules of the best group for an agent, as `gristmill.sources.robots.parsed` finds them for tables."""
    token = agent.strip().split("/")[0].split()[0].lower() if agent.strip() else ""
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    last = ""
    for line in body.splitlines():
        key, sep, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep or key not in ("user-agent", "allow", "disallow"):
            continue
        if key == "user-agent":
            if last != "user-agent":
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif groups and value:
            groups[-1][1].append((value, key == "allow"))
        last = key

    def score(names: list[str]) -> int:
        return max((3 if n == token else 2 if n and n != "*" and (token.startswith(n) or n.startswith(token)) else 1 if n == "*" else 0 for n in names), default=0)

    best = max(((score(n), -k) for k, (n, _) in enumerate(groups)), default=(0, 0))
    return groups[-best[1]][1] if best[0] else []


def path_allowed(rules: list[tuple[str, bool]], path: str) -> bool:
    return max(((len(p), allow) for p, allow in rules if path.startswith(p)), default=(0, True))[1]


def _origin(url: str) -> str:
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.netloc:
        raise FetchError("invalid-config", f"not an http URL: {url}")
    return f"{u.scheme}://{u.netloc.lower()}"


def _path(url: str) -> str:
    u = urlsplit(url)
    return (u.path or "/") + (f"?{u.query}" if u.query else "")


def _get(s: Session, url: str, headers: dict, source: dict, warnings: list[str]) -> dict:
    """One request with retries on timeouts, network errors, 429 and 5xx."""
    retries = min(source.get("retries") if source.get("retries") is not None else RETRIES, MOST_RETRIES)
    for attempt in range(retries + 1):
        try:
            r = s.client(url, headers, source.get("timeout_ms") or TIMEOUT_MS)
            again = r["status"] == 429 or 500 <= r["status"] <= 599
            why = f"status {r['status']}"
        except TimeoutError as e:
            r, again, why = FetchError("timeout", str(e) or "timed out"), True, "timeout"
        except Exception as e:  # whatever the client raises is a network error
            r, again, why = FetchError("network", str(e)), True, "network error"
        if not again or attempt == retries:
            if isinstance(r, FetchError):
                raise r
            return r
        warnings.append(f"retry {attempt + 1}/{retries} for {url} after {why}")
        s.clock.sleep(int(s.clock.draw() * BACKOFF_MS * 2 ** (attempt + 1)))
    raise AssertionError


def _allowed(s: Session, url: str, source: dict, warnings: list[str]) -> bool:
    if source.get("respect_robots") is False:
        return True
    where, agent = _origin(url), source.get("user_agent") or AGENT
    if where not in s.robots:
        rules: list[tuple[str, bool]] = []
        try:
            r = s.client(f"{where}/robots.txt", {"User-Agent": agent}, source.get("timeout_ms") or TIMEOUT_MS)
            if 200 <= r["status"] <= 299:
                rules = robots_rules(r.get("body") or "", agent)
            elif r["status"] == 429 or r["status"] >= 500:
                warnings.append(f"robots.txt of {where} returned {r['status']}; failing open")
        except Exception as e:
            warnings.append(f"robots.txt of {where} unreachable ({e}); failing open")
        s.robots[where] = rules
    return path_allowed(s.robots[where], _path(url))


def _kind(header: str, hint: str | None) -> str:
    h = header.lower()
    return hint or ("html" if "html" in h else "pdf" if "pdf" in h else "png" if "image/png" in h else "jpeg" if "image/jpeg" in h or "image/jpg" in h else "text")


def _plain(s: Session, source: dict, prior: dict | None, warnings: list[str]) -> dict:
    url, chain = source["url"], []
    headers = {"User-Agent": source.get("user_agent") or AGENT} | (source.get("headers") or {})
    sent = {}
    if source.get("revalidate") and prior and urldefrag(prior["url"])[0] == urldefrag(url)[0]:
        sent = {k: v for k, v in (("If-None-Match", prior.get("etag")), ("If-Modified-Since", prior.get("last_modified"))) if v}
    for hop in range(REDIRECTS + 1):
        where = _origin(url)
        if not _allowed(s, url, source, warnings):
            raise FetchError("robots-disallowed", f"robots.txt disallows {url}")
        delay = source.get("min_delay_ms")
        wait = (DELAY_MS if delay is None else delay) - (s.clock.now() - s.asked.get(where, float("-inf")))
        if wait > 0:
            s.clock.sleep(wait)
        try:
            r = _get(s, url, headers | (sent if not hop else {}), source, warnings)
        finally:
            s.asked[where] = s.clock.now()
        head = {k.lower(): v for k, v in (r.get("headers") or {}).items()}
        if r["status"] == 304 and sent and not hop:
            return prior | {"not_modified": True, "fetched_at": s.clock.stamp()}
        if r["status"] in (301, 302, 303, 307, 308) and head.get("location"):
            chain.append(url)
            url = urljoin(url, head["location"])
            headers = {k: v for k, v in headers.items() if k.lower() not in ("if-none-match", "if-modified-since")}
            continue
        if not 200 <= r["status"] <= 299:
            raise FetchError("http-error", f"{url} returned {r['status']}", r["status"])
        return _snapshot(s, source, url, r, head, chain)
    raise FetchError("too-many-redirects", f"more than {REDIRECTS} redirects from {source['url']}")


def _snapshot(s: Session, source: dict, url: str, r: dict, head: dict, chain: list[str], rendered: bool = False) -> dict:
    kind = "html" if rendered else _kind(head.get("content-type", ""), source.get("content_type"))
    binary = kind in ("pdf", "png", "jpeg")
    data = r.get("bytes") if binary and r.get("bytes") is not None else (r.get("body") or "").encode()
    return {
        "source_id": source["source_id"], "url": url, "fetched_at": s.clock.stamp(), "status": r["status"], "content_type": kind, "body": None if binary else data.decode(errors="replace"),
        "body_bytes": data if binary else None, "body_hash": hashlib.sha256(data).hexdigest(), "redirects": chain, "from_cache": False, "etag": head.get("etag"), "last_modified": head.get("last-modified"),
        "not_modified": False, "rendered": rendered,
    }


def _rendered(s: Session, source: dict, warnings: list[str]) -> dict:
    if s.renderer is None:
        raise FetchError("dependency-missing", "no renderer is given")
    if not _allowed(s, source["url"], source, warnings):
        raise FetchError("robots-disallowed", f"robots.txt disallows {source['url']}")
    warnings += [f"{k} doesn't apply to a rendered fetch" for k in ("revalidate", "headers", "retries") if source.get(k)]
    try:
        r = s.renderer(source["url"], source.get("timeout_ms") or TIMEOUT_MS)
    except Exception as e:
        raise FetchError("adapter-error", str(e)) from e
    if not 200 <= r["status"] <= 299:
        raise FetchError("http-error", f"{source['url']} rendered with {r['status']}", r["status"])
    return _snapshot(s, source, r.get("url") or source["url"], r, {}, [], True)


def looks_like_shell(html: str) -> bool:
    """Whether a page is the mere shell of one that scripts render: what `functions.text.shell_signals` warns of, without embedded state."""
    from gristmill.functions import markup
    from gristmill.functions import text as T

    size, held = len(html), markup.embedded_state(html)
    if not size or held["json_ld"] or held["next_data"] is not None or held["initial_state"] is not None:
        return False
    text = len(markup.html_markdown(html))
    scripts = (size - len(re.sub(T.SCRIPT_BLOCK.replace("\\z", "\\Z"), "", html))) / size
    mount = re.search(T.EMPTY_MOUNT, html) is not None
    return text < T.SHELL_FLOOR and text / size < T.SHELL_TEXT_RATIO and (scripts >= T.SHELL_SCRIPT_RATIO or mount)


def render_policy(source: dict) -> str:
    """The policy of a source, from `render_policy` and the older flag `render`, which must not contradict it."""
    policy, legacy = source.get("render_policy"), source.get("render")
    if policy is not None and policy not in ("never", "always", "on-shell-warning"):
        raise FetchError("invalid-config", f"unsupported renderPolicy: {policy}")
    if policy is not None and legacy is not None and policy != ("always" if legacy else "never"):
        raise FetchError("invalid-config", f"render ({str(bool(legacy)).lower()}) conflicts with renderPolicy ({policy})")
    return policy or ("always" if legacy else "never")


def _ref(shot: dict) -> str:
    """As `functions.urls.snapshot_ref` writes it."""
    from urllib.parse import quote, quote_plus

    form = lambda x: quote_plus(x, safe="*").replace("~", "%7E")
    return f"snapshot:{quote(shot['source_id'], safe=chr(39) + '!~*()')}?url={form(shot['url'])}&sha256={shot['body_hash']}&fetchedAt={form(shot['fetched_at'])}"


def fetch_one(s: Session, source: dict, prior: dict | None = None, is_shell: Callable[[str], bool] = looks_like_shell) -> dict:
    """A dict (snapshot or None, error or None, warnings, escalation or None) for one source; never raises.

    render_policy: `never` fetches plainly, `always` renders, `on-shell-warning` renders a page that `is_shell` and keeps the plain one if that fails. The escalation tells (policy, shell_warning,
    attempted, outcome, first_ref, error_kind); a rendered attempt sends no validators.
    """
    warnings: list[str] = []
    told = None
    try:
        policy = render_policy(source)
        if not source.get("source_id"):
            raise FetchError("invalid-config", "a source needs an id")

        def tell(shell: bool, attempted: bool, outcome: str, first: dict | None = None, error: FetchError | None = None) -> dict:
            return {"policy": policy, "shell_warning": shell, "attempted": attempted, "outcome": outcome, "first_ref": _ref(first) if first else None, "error_kind": error.kind if error else None}

        if policy == "always":
            return {"snapshot": _rendered(s, source, warnings), "error": None, "warnings": warnings, "escalation": tell(False, True, "rendered")}
        plain = _plain(s, source, prior, warnings)
        if policy == "on-shell-warning":
            if plain["content_type"] != "html" or plain["not_modified"] or not is_shell(plain["body"] or ""):
                told = tell(False, False, "not-needed")
            elif s.renderer is None:
                told = tell(True, False, "renderer-unavailable-fallback", plain)
            else:
                bare = {k: v for k, v in source.items() if k != "revalidate"}
                try:
                    rendered = _rendered(s, bare, warnings)
                    told, plain = tell(True, True, "rendered", plain), rendered
                except FetchError as e:
                    told = tell(True, True, "render-failed-fallback", plain, e)
        return {"snapshot": plain, "error": None, "warnings": warnings, "escalation": told}
    except FetchError as e:
        return {"snapshot": None, "error": {"kind": e.kind, "message": str(e), "status": e.status}, "warnings": warnings, "escalation": told}


_SNAPSHOT = (
    "struct<source_id:string,url:string,fetched_at:string,status:int,content_type:string,body:string,body_bytes:binary,body_hash:string,redirects:array<string>,from_cache:boolean,"
    "etag:string,last_modified:string,not_modified:boolean,rendered:boolean>"
)
_TOLD = "struct<policy:string,shell_warning:boolean,attempted:boolean,outcome:string,first_ref:string,error_kind:string>"
RESULT = f"source_id string, snapshot {_SNAPSHOT}, error struct<kind:string,message:string,status:int>, warnings array<string>, escalation {_TOLD}"


def fetched(sources: DataFrame, client: Callable, renderer: Callable | None = None, clock: Clock | None = None, prior: DataFrame | None = None) -> DataFrame:
    """RESULT for each of `sources` (source_id, url, ... the options of a source).

    `prior`: snapshots; the latest of a source that wants to revalidate gives the validators, and its body if it isn't modified. Spark may run a task again after a failure; requests are reads, so
    that only costs politeness, but reading the result twice fetches twice: write it. Speculative execution should be off.
    """
    names = sources.columns
    if prior is not None:
        from .snapshots import latest

        known = latest(prior).select("source_id", F.struct(*[F.col(c) for c in prior.columns]).alias("prior_snapshot"))
        sources = sources.join(known, "source_id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Session(client, clock or Clock(), renderer)
        for part in parts:
            rows = part.astype(object).where(part.notna(), None).to_dict("records")
            out = []
            for r in rows:
                before = r.get("prior_snapshot")
                before = before.asDict() if hasattr(before, "asDict") else before
                got = fetch_one(s, {k: r[k] for k in names}, before)
                if got["snapshot"]:
                    got["snapshot"] = {k: got["snapshot"].get(k) for k in _FIELDS}
                out.append({"source_id": r.get("source_id")} | got)
            yield pd.DataFrame(out, columns=["source_id", "snapshot", "error", "warnings", "escalation"])

    by = origin(F.col("url"))
    return sources.repartition(by).sortWithinPartitions(by, "source_id").mapInPandas(run, RESULT)


_FIELDS = "source_id url fetched_at status content_type body body_bytes body_hash redirects from_cache etag last_modified not_modified rendered".split()
