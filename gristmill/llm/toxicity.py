"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of three characters that both have, decay to the
power of the characters they span in both, scaled to 1 for equal strings. Gaps and inserted characters so cost similarity, but don't
break a match. Words are compared to a few landmarks; the similarities, whitened by the landmarks' own, are
the features of a linear machine with squared hinge loss.

Labels are of texts, sentences or whole documents, so training is by witness: the landmarks are substrings that cover the toxic texts
and that clean ones hardly have, and clean words most like them, chosen by pivoted Cholesky. Words with
such a substring are the positives, as they are and with a character inserted; all words of clean texts
are negatives. What is judged is a window of words, in two sizes, WINDOWS: about a sentence or two for plain insults, and pages for many that are
less plain. Half of a window is in the next one, and the last is as long as the text is left. A window
is the more surprising, the more of its words score higher than those of clean windows do; a document is judged by its most surprising windows, so that
length neither hides a toxic sentence nor adds up to one. The limits are taken from held-out clean documents, by a quantile, so that a wrong label among them doesn't move them.

A word is what stands between white space, lower-case, letters and digits only, so that `i-d.i*o-t` is one; a
run of three or more single letters (`i d i o t`) is one too. Words of over LONG characters are read in
overlapping windows. Each task scores a distinct word once, prefixes in common together. The kernel needs three characters, marks of
beginning and end included: words of one character have none, and an insult of two inside a longer run without spaces isn't seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kind_of
from .kernels import slices, token_spans

DECAY, LONG, LANDMARKS, LANDMARK_CHARS = 0.7, 16, 32, 12
#: The most documents of either class whose words the machine is trained on.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 2000
SHORTEST, RUN, CACHE, CHANCE = 2, 3, 1_000_000, 10.0
CUTS, LEAST_SURPRISE, FREE = (-0.5, -0.3, -0.1, 0.1, 0.3, 0.5, 0.65, 0.8, 0.95), 2.0, 0.02
WINDOWS = (64, 512)
#: A document is toxic if it is TIMES less likely than the least likely QUANTILE of clean ones.
QUANTILE, TIMES = 0.995, 10.0


def codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def self_kernel(w: np.ndarray) -> np.ndarray:
    """The unscaled kernel of each row of codes (0: no character) with itself."""
    n, width = w.shape
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    k1 = np.zeros((width + 1, n), np.float32)
    k2, out = np.zeros_like(k1), np.zeros(n, np.float32)
    for c in range(width):
        x = w[:, c]
        if not x.any():
            break
        same = ((w.T == x) & (x > 0)).astype(np.float32) * d2
        out += (same * k2[:-1]).sum(0)
        a1 = a2 = np.zeros(n, np.float32)
        step2 = same * k1[:-1]
        k1 *= d
        k2 *= d
        for j in range(width):
            a1 = a1 * d + same[j]
            a2 = a2 * d + step2[j]
            k1[j + 1] += a1
            k2[j + 1] += a2
    return out


def cross_kernel(words: list[str], marks: np.ndarray, width: int = LONG, chunk: int = 1024) -> np.ndarray:
    """The unscaled kernel of sorted distinct words with each row of the codes `marks`.

    The state after a prefix is computed once for all neighbouring words that have it.
    """
    m, t = marks.shape[1], len(marks)
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    out = np.zeros((len(words), t), np.float32)
    for at in range(0, len(words), chunk):
        w = codes(words[at : at + chunk], width)
        n = len(w)
        lengths = (w > 0).sum(1)
        common = np.zeros(n, np.int64)
        if n > 1:
            differ = w[1:] != w[:-1]
            common[1:] = np.where(differ.any(1), differ.argmax(1), width)
        k1 = np.zeros((m + 1, 1, t), np.float32)
        k2, total = np.zeros_like(k1), np.zeros((1, t), np.float32)
        group = np.zeros(n, np.int64)  # of each word, the state of its prefix so far
        for c in range(int(lengths.max(initial=0))):
            live = lengths > c
            fresh = live & ((common <= c) | ~np.concatenate([[False], live[:-1]]))
            # a word whose prefix equals the one before it shares its state
            first = np.flatnonzero(fresh)
            parent = group[first]
            now = np.cumsum(fresh) - 1
            x = w[first, c]
            same = (marks.T[:, None, :] == x[None, :, None]).astype(np.float32)
            same *= d2
            p1, p2 = k1[:, parent], k2[:, parent]
            total_now = total[parent] + np.einsum("jnt,jnt->nt", same, p2[:-1])
            step2 = same * p1[:-1]
            p1 *= d
            p2 *= d
            for j in range(m):
                if j:
                    same[j] += same[j - 1] * d
                    step2[j] += step2[j - 1] * d
            p1[1:] += same
            p2[1:] += step2
            ends = live & (lengths == c + 1)
            out[at + np.flatnonzero(ends)] = total_now[now[ends]]
            k1, k2, total = p1, p2, total_now
            group = np.where(live, now, 0)
    return out


def windows(word: str) -> list[str]:
    """The word with marks where it begins and ends, or its overlapping parts of LONG characters."""
    if len(word) <= LONG:
        return [bounded(word)]
    marked = bounded(word)
    step = LONG - LANDMARK_CHARS  # a landmark's span is whole in one of them
    return [marked[i : i + LONG] for i in range(0, len(marked) - LANDMARK_CHARS + 1, step)]


_DROP = re.compile(r"[\W_]+")


def clean(raw: str) -> str:
    return raw if raw.isalnum() else _DROP.sub("", raw)


def letters(w: np.ndarray) -> np.ndarray:
    """A bit for each of 32 classes of letters that the rows of codes have."""
    return np.bitwise_or.reduce(np.where(w > 0, np.uint32(1) << (w % 32).astype(np.uint32), np.uint32(0)), axis=1)


def bounded(word: str) -> str:
    """With marks where it begins and ends."""
    return f"^{word}$"


def surprise(hits: int, mean: float) -> float:
    """-log10 of the probability of at least so many hits where `mean` are expected, by Poisson; 0 if that is no excess."""
    if hits <= mean or mean <= 0:
        return 0.0
    log = -mean + hits * math.log(mean) - math.lgamma(hits + 1) - math.log1p(-mean / (hits + 1))
    return max(0.0, -log / math.log(10))


class Machine:
    """Scores words, and windows of words by theirs.

    A window's surprise is the highest, over CUTS, that so many of its distinct words score above the cut, given the
    share that do in clean windows (`rates`, by size of window); a document's score is by how much its most surprising windows pass the `limits` of their size.

    A word that lacks a letter of every landmark of positive weight scores -1 at once: gaps and inserted
    characters take no letter away.
    """

    def __init__(self, marks: list[str], alpha: np.ndarray, bias: float):
        self.names, self.alpha, self.bias = marks, alpha.astype(np.float32), float(bias)
        self.codes = codes(marks, max(map(len, marks), default=1)) if marks else np.zeros((0, 1), np.uint32)
        self.own = np.maximum(self_kernel(self.codes), 1e-12) if marks else np.zeros(0, np.float32)
        self.letters = letters(self.codes[self.alpha > 0]) if marks else np.zeros(0, np.uint32)
        self.rates, self.limits = [[1.0] * len(CUTS) for _ in WINDOWS], [LEAST_SURPRISE for _ in WINDOWS]

    def similarities(self, words: list[str]) -> np.ndarray:
        """Scaled to 1 for equal strings; words of at most LONG characters, with their marks."""
        order = sorted(range(len(words)), key=words.__getitem__)
        k = np.empty((len(words), len(self.names)), np.float32)
        k[order] = cross_kernel([words[i] for i in order], self.codes, LONG + 2)
        own = [self_kernel(codes(words[i : i + 4096], LONG + 2)) for i in range(0, len(words), 4096)]
        return k / np.sqrt(np.maximum(np.concatenate([*own, np.zeros(0)]), 1e-12)[:, None] * self.own)

    def window(self, high: list[float], number: int, rates: list[float]) -> tuple[float, int]:
        """(surprise, words above the cut that gives it) of a window of `number` distinct words, those above the lowest cut of scores `high`."""
        best, most = 0.0, 0
        for cut, rate in zip(CUTS, rates):
            hits = sum(v > cut for v in high)
            if not hits:
                break
            found = surprise(hits, rate * number)
            if found > best:
                best, most = found, hits
        return best, most

    def surprises(self, words: list[str], hot: dict[str, float]) -> list[tuple[float, int]]:
        """By size of window, (surprise, words above its cut) of the most surprising one of a document; `hot`: the scores of words above the lowest cut.

        For sizes beyond the first, whose evidence is many weak words, the surprise is that of the best of so many windows.
        """
        at, out = [i for i, w in enumerate(words) if w in hot], []
        for size, rates in zip(WINDOWS, self.rates):
            best = (0.0, 0)
            for k in sorted({k for i in at for k in window_starts(i, len(words), size)}):
                part = set(words[k : k + size])
                best = max(best, self.window([hot[w] for w in part if w in hot], len(part), rates))
            many = max(1, 2 * len(words) // size) if size > WINDOWS[0] else 1
            out.append((max(0.0, best[0] - math.log10(many)), best[1]))
        return out

    def document(self, words: list[str], hot: dict[str, float]) -> tuple[float, int]:
        """(score, words above the cut of the window that gives it) of a document."""
        return max((found - limit, number) for (found, number), limit in zip(self.surprises(words, hot), self.limits))

    def near(self, words: list[str]) -> np.ndarray:
        have = letters(codes(words, LONG + 2))
        out = np.zeros(len(words), bool)
        for mask in self.letters:
            out |= mask & ~have == 0
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Of cleaned words of any length; those of under SHORTEST characters score -1."""
        parts = [windows(w) if len(w) >= SHORTEST else [] for w in words]
        flat = [p for x in parts for p in x]
        out = np.full(len(words), -1.0)
        if flat and self.names:
            word = np.repeat(np.arange(len(words)), [len(x) for x in parts])
            on = np.flatnonzero(self.near(flat))
            if len(on):
                s = self.similarities([flat[i] for i in on]) @ self.alpha + self.bias
                np.maximum.at(out, word[on], s)
        return out


def window_starts(i: int, n: int, size: int) -> list[int]:
    """Where the windows of a text of n words begin that have word i."""
    half = size // 2
    last = max(0, -(-(n - size) // half))
    k = i // half
    return [x * half for x in (k - 1, k) if 0 <= x <= last or x == 0]


def word_lists(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(row, raw words in order, joined runs of single letters before the word in which they begin) of each text."""
    for i, j, buf, offs in slices(column):
        starts, ends, _, _ = token_spans(buf, offs)
        raw = buf.tobytes()
        lead = buf[starts] if len(starts) else buf[:0]
        letter = np.where(lead < 128, 1, np.where(lead < 224, 2, np.where(lead < 240, 3, 4)))
        single = (ends - starts) == letter
        doc = np.searchsorted(offs, starts, "right")
        go = np.concatenate([[0], single.astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(go))
        extra: dict[int, list[tuple[int, str]]] = {}
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < RUN:
                continue
            for d in range(doc[a], doc[b - 1] + 1):
                x, y = np.searchsorted(doc[a:b], [d, d + 1]) + a
                if y - x >= RUN:
                    joined = b"".join(raw[starts[k] : ends[k]] for k in range(x, y)).decode(errors="ignore").lower()
                    extra.setdefault(d - 1, []).append((int(starts[x]), joined))
        for k in range(j - i):
            if k not in extra:
                yield i + k, raw[offs[k] : offs[k + 1]].decode(errors="ignore").lower().split()
                continue
            words, at = [], int(offs[k])
            for start, joined in extra[k]:
                words += raw[at:start].decode(errors="ignore").lower().split()
                words.append(joined)
                at = start
            yield i + k, words + raw[at : offs[k + 1]].decode(errors="ignore").lower().split()


def _varied(word: str, rng: np.random.Generator, times: int) -> list[str]:
    """The marked word with a letter inserted somewhere inside."""
    out = []
    for _ in range(times):
        at = int(rng.integers(2, max(3, len(word) - 1)))
        out.append(word[:at] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + word[at:])
    return [x for x in out if len(x) <= LONG + 2]


def _newton(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1e-3, rounds: int = 30):
    """Weights and bias of least ridge/2 |v|^2 + mean squared hinge, weighted by c."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = c / c.sum()
    v = np.zeros(x1.shape[1])
    reg = np.full(len(v), ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        on = y * (x1 @ v) < 1
        a, w = x1[on], c[on][:, None]
        new = np.linalg.solve(a.T @ (a * w) + np.diag(reg), a.T @ (w[:, 0] * y[on]))
        if np.abs(new - v).max() < 1e-6:
            break
        v = new
    return v[:-1], v[-1]


def stems(documents: list[set[str]], clear: Counter, good: int, most: int) -> list[str]:
    """Greedy cover of the toxic documents' own words by substrings that clean ones hardly have.

    Substrings of 4 to LANDMARK_CHARS characters of marked words that no clean document has; each pick is
    the one in most words of documents not yet covered, and of the longer ones that contain it and have 0.8 as many, the longest. It must be in at least 1 %
    of the documents, in more than chance explains, and 20 times as likely in a toxic document as in a clean one.
    """
    bad = len(documents)
    own = [(k, w) for k, words in enumerate(documents) for w in sorted(words) if w not in clear]
    # so many that, of documents of either class by chance, all are toxic once in e**CHANCE substrings
    least = max(2, math.ceil(0.01 * bad), math.ceil(CHANCE / math.log((bad + good) / bad)))
    where: dict[str, set[int]] = {}
    level: dict[str, set[int]] = {}
    doc = [k for k, _ in own]
    # a substring is often enough in words only if those one shorter are
    for n in range(4, LANDMARK_CHARS + 1):
        counts: Counter = Counter()
        for _, w in own:
            counts.update({w[i : i + n] for i in range(len(w) - n + 1) if n == 4 or w[i : i + n - 1] in level and w[i + 1 : i + n] in level})
        often = {x for x, c in counts.items() if c >= least}
        level = {}
        for i, (_, w) in enumerate(own):
            for x in {w[j : j + n] for j in range(len(w) - n + 1)} & often:
                level.setdefault(x, set()).add(i)
        level = {x: d for x, d in level.items() if len({doc[i] for i in d}) >= least}
        where |= level
        if not level:
            break
    found: Counter = Counter()
    for w, n in clear.items():
        for i in range(len(w) - 3):
            for x in (w[i : i + k] for k in range(4, min(LANDMARK_CHARS, len(w) - i) + 1)):
                if x in where:
                    found[x] += n
    where = {x: d for x, d in where.items() if len(d) / bad >= 20 * found[x] / good}
    out: list[str] = []
    while where and len(out) < most:
        best = max(where, key=lambda x: (len(where[x]), len(x), x))
        enough = 0.8 * len(where[best])
        best = max((x for x in where if best in x and len(where[x]) >= enough), key=lambda x: (len(x), len(where[x]), x))
        out.append(best)
        covered = set().union(*(d for x, d in where.items() if best in x or x in best))
        where = {x: d for x, d in ((x, d - covered) for x, d in where.items()) if len(d) >= least}
    return out


def train(texts: Iterable[tuple[str, int]], landmarks: int = LANDMARKS, seed: int = 5) -> Machine:
    """The machine of labelled texts (text, toxic 0 or 1), sentences or documents; one that finds nothing toxic if a class is missing."""
    clear, documents, fine, data = Counter(), [], [], list(texts)
    column = pa.array([t for t, _ in data], pa.large_string())
    held: list[list[str]] = []  # every fourth clean document, for the rates and the limit
    for k, raw in word_lists(column):
        bare = [clean(w) for w in raw]
        words = {p for w in set(bare) if len(w) >= SHORTEST for p in windows(w)}
        if data[k][1]:
            documents.append(words)
        elif len(fine) > 3 * len(held) + 2:
            held.append(bare)
        else:
            clear.update(words)
            fine.append(words)
    bad, good = len(documents), len(fine)
    nothing = Machine([], np.zeros(0), -1.0)
    if not bad or not good:
        return nothing
    found = stems(documents, clear, good, landmarks * 2 // 3)
    if not found:
        return nothing
    witnesses: Counter = Counter()
    for words in documents:
        witnesses.update(w for w in words if clear[w] == 0 and any(x in w for x in found))
    negatives = sorted(clear)
    # the other landmarks are the clean words most like the first ones, by pivoted Cholesky
    first = Machine(found, np.ones(len(found)), 0.0)
    hard = [w for w, on in zip(negatives, first.near(negatives)) if on]
    close = first.similarities(hard).max(1) if hard else np.zeros(0)
    pool = found + [hard[k] for k in np.argsort(-close, kind="stable")[:300] if len(hard[k]) <= LANDMARK_CHARS]
    gram = Machine(pool, np.ones(len(pool)), 0.0).similarities(pool).astype(float)
    left, picked, basis = np.ones(len(pool)), [], np.zeros((len(pool), 0))
    while len(picked) < min(landmarks, len(pool)):
        k = len(picked) if len(picked) < len(found) else int(np.argmax(left))
        if k >= len(found) and left[k] < 0.05:
            break
        picked.append(k)
        new = (gram[:, k] - basis @ basis[k]) / math.sqrt(max(left[k], 1e-3))
        basis = np.hstack([basis, new[:, None]])
        left = np.maximum(left - new**2, 0)
    marks = [pool[k] for k in picked]
    values, vectors = np.linalg.eigh(gram[np.ix_(picked, picked)])
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    base = Machine(marks, np.ones(len(marks)), 0.0)
    rng = np.random.default_rng(seed)
    x_neg = base.similarities(hard) @ whiten if hard else np.zeros((0, len(marks)))
    c_neg = np.array([clear[w] for w in hard], float)
    pos = sorted(witnesses)
    varied = [(v, witnesses[w] / 2) for w in pos for v in _varied(w, rng, 3) if v not in clear]
    words = pos + [v for v, _ in varied]
    x_pos = base.similarities(words) @ whiten
    c_pos = np.array([witnesses[w] for w in pos] + [c for _, c in varied], float)
    c = np.concatenate([c_pos / c_pos.sum(), 4 * np.sqrt(c_neg) / max(np.sqrt(c_neg).sum(), 1)])
    y = np.concatenate([np.ones(len(words)), -np.ones(len(hard))])
    v, bias = _newton(np.vstack([x_pos, x_neg]), y, c)
    machine = Machine(marks, whiten @ v, bias)
    known = sorted(set().union(*held))
    hot = {w: x for w, x in zip(known, machine.scores(known).tolist()) if x > CUTS[0]}
    for s, size in enumerate(WINDOWS):
        parts = [set(words[k : k + size]) for words in held for k in range(0, max(1, len(words)), size)]
        number, high = sum(map(len, parts)) + 1, [hot[w] for p in parts for w in p if w in hot]
        machine.rates[s] = [max(FREE, sum(x > cut for x in high)) / number for cut in CUTS]
    if held:
        most = np.array([[x for x, _ in machine.surprises(words, hot)] for words in held])
        machine.limits = [max(LEAST_SURPRISE, float(np.quantile(x, QUANTILE)) + math.log10(TIMES)) for x in most.T]
    return machine


def _scorer(machine: Machine):
    """The score and the number of toxic words of each text; a distinct word is scored once in a partition."""
    seen: set[str] = set()
    hot: dict[str, float] = {}

    def run(column: pa.Array) -> tuple[list[float], list[int]]:
        highest, hits, part = [], [], []

        def flush():
            if len(seen) > CACHE:
                seen.clear()
                hot.clear()
            new = list(set().union(*part) - seen)
            seen.update(new)
            bare = {w: clean(w) for w in new}
            distinct = sorted(set(bare.values()))
            value = dict(zip(distinct, machine.scores(distinct).tolist()))
            hot.update((w, value[x]) for w, x in bare.items() if value[x] > CUTS[0])
            for words in part:
                score, number = machine.document(words, hot)
                highest.append(score)
                hits.append(number if score > 0 else 0)
            part.clear()

        for _, words in word_lists(column):
            part.append(words)
            if len(part) == 500:
                flush()
        flush()
        return highest, hits

    return run


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(machine)
        for batch in batches:
            highest, hits = score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(highest, pa.float64()), pa.array(hits, pa.int32()), pa.array([h > 0 for h in hits], pa.bool_())],
                ["doc_id", "score", "toxic_words", "toxic"],
            )

    return run


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clear: int = CLEAN_SAMPLE):
    """(text, toxic) of at most so many labelled documents of each class, those of lowest hashed doc_id.

    Null ids, labels and texts don't count, nor do ids that are labelled both ways; of rows that repeat an id, the least text does. Missing or empty
    tables give an empty list.
    """
    ids = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("other"))
        .where("y = other and y in (0, 1)").select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"))
    )
    few = [ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, toxic), (0, clear))]
    few = cut(few[0].union(few[1]))
    rows = (
        docs.where("text is not null").select("doc_id", "text")
        .join(F.broadcast(few), F.col("doc_id") == F.col("id"))  # at most toxic + clear rows
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    )
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, toxic_words, toxic) of each row; toxic where the score is above 0.

    toxic_words: how many distinct words of its most surprising window made it so. Null and empty texts, and texts without words, have the least
    score and aren't toxic; repeated rows each give a row; doc_id is of any type, null too; other columns are ignored, whatever their names; no rows give no rows.
    """
    kind = kind_of(docs, "doc_id")
    return docs.select("doc_id", "text").mapInArrow(_scored(machine), f"doc_id {kind}, score double, toxic_words int, toxic boolean")


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` without toxic rows; same columns, of whatever names. In one pass: the rows never leave their partition.

    Null and empty texts stay, and rows of null doc_id are judged like others; repeated rows go or stay together; an empty table gives an empty table.
    """
    at = [n.lower() for n in docs.columns].index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(machine)
        for batch in batches:
            _, hits = score(batch.column(at))
            yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
