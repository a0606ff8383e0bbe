"""License scans by conditional compression.

Words of licences are cues; the text around them, as far as any wording goes on without a cue, is a block. Each block is compressed with
zstandard alone, and with every wording as a raw dictionary: the one that takes most of its size away is the
likeliest. By that rank, wordings are held against the block word by word, at the places where enough of their pairs of
words are; the first whose differences are few enough, and in none of the words that tell licences apart, is confirmed, with
the words missing and added. Line ends, case and punctuation don't count.

A document without a cue, found by Spark on the whole text, never reaches Python.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of
from .license_texts import TEMPLATES

LEVEL, MOST_DIFFERENT, KNOWN = 6, 0.3, 50_000
CUE = r"(?i)licen[cs]|copyright|rights\W{1,9}reserved|public\W{1,9}domain|warrant(?:y|ies)|redistribut|permission\W{1,9}(?:is|to)\W|spdx|creative\W{1,9}commons"
_CUE = re.compile(CUE)
_WORD = re.compile(r"(?:version|\bv)\.?\s*(\d+(?:\.\d+)*)|(\d)[-\s]clause|\d+(?:\.\d+)+|[^\W_]+")


def tokens(text: str) -> tuple[list[str], list[int]]:
    """(words, where each begins); `Version 2.0` and `v2` are one word, as is `3-Clause`."""
    out, at = [], []
    low = text.lower()
    if len(low) != len(text):  # a few characters grow; their places are those of the lower text then
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for m in _WORD.finditer(low):
        if m.group(1):
            word = "v" + re.sub(r"\.0$", "", m.group(1))
        elif m.group(2):
            word = m.group(2) + "clause"
        else:
            word = m.group(0)
            word = {"licence": "license", "licences": "licenses", "licenced": "licensed"}.get(word, word)
        out.append(word)
        at.append(m.start())
    return out, at


def words(text: str) -> list[str]:
    return tokens(text)[0]


WORDS = [words(t) for _, t in TEMPLATES]
_COMMON = set("released under the license licensed this work is project terms of file subject to general public a and in or by with be that".split())
#: Words that tell licences apart: a wording's own may not be missing, others not be added.
_TELLING = set(
    "mit apache gnu lesser library affero mozilla bsd isc cc cc0 noncommercial sharealike noderivatives nc nd sa 0bsd zlib boost eclipse wtfpl unlicense only 2clause 3clause "
    "neither endorse substantial appear either".split()
)


def _telling(template: list[str]) -> set[str]:
    return _TELLING | ({"by"} if {"cc", "creative"} & set(template) else set())


def _tells(word: str) -> bool:
    return bool(re.fullmatch(r"v\d.*|\d+\.[\d.]+", word))


#: Of each wording, its words that may not be missing; of short ones, all that aren't in everybody's mouth.
OWN = [{w for w in t if w in _telling(t) or _tells(w)} | (set(t) - _COMMON if len(t) <= 12 else set()) for t in WORDS]


def _reach() -> int:
    """The longest stretch of a wording without a cue, and some room for differences."""
    most = 0
    for _, t in TEMPLATES:
        ends = [0] + [x for m in _CUE.finditer(t) for x in m.span()] + [len(t)]
        most = max(most, *(b - a for a, b in zip(ends[::2], ends[1::2])))
    return math.ceil(most * (1 + MOST_DIFFERENT)) + 60


REACH = _reach()
#: Long blocks are read in overlapping pieces; any wording is whole in one of them.
PIECE, OVERLAP = 8192, math.ceil(max(len(t) for _, t in TEMPLATES) * 1.5)


def spans(text: str) -> Iterator[tuple[int, int]]:
    """The surroundings of cues, those that touch together."""
    start = end = -1
    for m in _CUE.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = b
    if end >= 0:
        yield start, end


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(character, text) of each block or piece of one."""
    for start, end in spans(text):
        for a in range(start, max(start + 1, end - OVERLAP), PIECE - OVERLAP):
            yield a, text[a : min(end, a + PIECE)]


@cache
def _compressors():
    options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    alone = zstandard.ZstdCompressor(**options)
    data = [" ".join(t.lower().split()).encode() for _, t in TEMPLATES]
    given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for d in data]
    return alone, given


def ranked(block: str) -> list[tuple[float, int]]:
    """(share of the compressed size that the wording takes away, wording) of all wordings, the largest first."""
    alone, given = _compressors()
    data = " ".join(block.lower().split()).encode()
    size = len(alone.compress(data))
    out = [((size - len(c.compress(data))) / size, k) for k, c in enumerate(given)]
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _pairs() -> dict[tuple[str, str], list[tuple[int, int]]]:
    out: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for k, t in enumerate(WORDS):
        for j, pair in enumerate(zip(t, t[1:])):
            out.setdefault(pair, []).append((k, j))
    return out


PAIRS = _pairs()


def places(block: list[str]) -> dict[int, list[tuple[int, int]]]:
    """By wording, ranges of the block's words where it may be: where enough of its pairs of words stand in line."""
    votes: dict[int, Counter] = {}
    for i, pair in enumerate(zip(block, block[1:])):
        for k, j in PAIRS.get(pair, ()):
            votes.setdefault(k, Counter())[(i - j) // max(3, len(WORDS[k]) // 4)] += 1
    found = {}
    for k, seen in votes.items():
        m = len(WORDS[k])
        wide, slack = max(3, m // 4), math.ceil(MOST_DIFFERENT * m) + 2
        out, used = [], set()
        for x in sorted(seen, key=lambda x: (-seen[x], x)):
            if x not in used and seen[x - 1] + seen[x] + seen[x + 1] >= 0.4 * (m - 1):
                used |= {x - 1, x, x + 1}
                out.append((max(0, x * wide - slack), min(len(block), x * wide + wide + m + slack)))
        if out:
            found[k] = sorted(out)
    return found


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
    """(words of the template that the block lacks, words of the block between the first and the last matched, where these are)."""
    matches = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not matches:
        return template, [], 0, 0
    have_t = {i for m in matches for i in range(m.a, m.a + m.size)}
    have_b = {j for m in matches for j in range(m.b, m.b + m.size)}
    first, last = matches[0].b, matches[-1].b + matches[-1].size
    return [w for i, w in enumerate(template) if i not in have_t], [block[j] for j in range(first, last) if j not in have_b], first, last


def confirmed(missing: list[str], added: list[str], k: int) -> bool:
    if len(missing) + len(added) > MOST_DIFFERENT * len(WORDS[k]):
        return False
    telling = _telling(WORDS[k])
    return not any(w in OWN[k] for w in missing) and not any((w in telling or _tells(w)) and w not in OWN[k] for w in added)


def identify(block: str) -> list[tuple[int, str, float, list[str], list[str]]]:
    """(character, licence, reduction, missing, added) of all licences confirmed in the block, in the order of rank.

    A wording inside the range of one that takes more away isn't counted again.
    """
    own, at = tokens(block)
    out, ranges, where = [], [], places(own)
    for reduction, k in ranked(block) if where else ():
        name = TEMPLATES[k][0]
        for a, b in where.get(k, ()):
            missing, added, first, last = differences(own[a:b], WORDS[k])
            first, last = a + first, a + last
            if not confirmed(missing, added, k) or any(x < last and first < y for x, y in ranges):
                continue
            ranges.append((first, last))
            out.append((at[first], name, reduction, missing, added))
    return out


def licenses_of(text: str, known: dict[str, list] | None = None) -> list[tuple[int, str, float, list[str], list[str]]]:
    """(character, licence, reduction, missing, added) of all licences in a text; `known` keeps what was found in blocks."""
    known, out = {} if known is None else known, {}
    for at, block in blocks(text):
        found = known.get(block)
        if found is None:
            found = identify(block)
            if len(known) >= KNOWN:
                known.clear()
            known[block] = found
        for x in found:
            out.setdefault((at + x[0], x[1]), x[2:])  # pieces overlap
    return [(*k, *v) for k, v in out.items()]


def _scan():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            where, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = licenses_of(text, known)
                rows += found
                where += [k] * len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(where, pa.int64())),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([round(r[2], 6) for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.list_(pa.string())),
                    pa.array([r[4] for r in rows], pa.list_(pa.string())),
                ],
                ["doc_id", "at", "license", "reduction", "missing", "added"],
            )

    return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, at, license, reduction, missing, added) of every licence confirmed in a text; `at` is its first character.

    Null and empty texts give no rows; a text with several licences gives several. Texts are read whole. Repeated rows each
    give their rows; doc_id is of any type, null too; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    kind = kind_of(docs, "doc_id")
    schema = f"doc_id {kind}, at bigint, license string, reduction double, missing array<string>, added array<string>"
    return docs.where(F.col("text").rlike(CUE)).select("doc_id", "text").mapInArrow(_scan(), schema)
