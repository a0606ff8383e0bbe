"""Self-join of documents by the Jaccard similarity of their n-gram sets, with signature trees.

1. Each text becomes its set of hashed n-grams of `n` tokens. Rows of equal sets are copies, one text; one row stands for them.
2. Cells. Most similar texts share a band of MinHash values (BANDS bands of ROWS values); the connected components of shared bands
   are cells. The rest is found exactly, by keys that similar texts can't fail to share (`pair_keys`): texts of different cells that share one, and whose
   sizes and parity bitmaps leave them similar, join their cells. So every similar pair is in one cell. Texts travel once, to their cell.
3. In a cell, a signature tree: the texts, ordered by size, are leaves with a bitmap of their n-grams; a node
   above FAN others holds their OR-combined bitmap, their range of sizes and the most n-grams that any has beyond its
   bits. The tree is traversed against itself: a pair of nodes goes on only if some pair below it could reach the
   threshold, that is, by the sizes and by the bits that both have. Pairs of leaves that remain are verified
   on the sets.

A cell of over PART texts is split by classes of size, of which only neighbours can be similar, and these by hash into parts; each
pair of parts is a task with a tree for each side, so no task grows with the cell and no pair is left out.

A task returns, for each text, how many rows it is similar to and the least text that it is connected with: what is
written grows with the texts, not with their pairs. Hot keys (a band or a text that a third of the rows have) are aggregated on the map side
and joined with one row a key, which Spark can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, kind_of, written
from .graph import connected_components
from .kernels import U64, gram_sets, mix

N, THRESHOLD, BANDS, ROWS, FAN, PART = 2, 0.7, 36, 5, 8, 4096
#: Sets of up to so many n-grams have MinHash by permutations; larger ones by one permutation with bins.
SMALL = 256
#: Documents whose n-grams are counted to tell the frequent ones, and how many of these are told apart; the order of n-grams decides the work, never the result.
SAMPLE, FREQUENT = 4096, 1 << 16
#: The share of a space's least size that has to be common within the prefixes; n-grams in a bucket of keys; texts of a key that are written as pairs.
COMMON, BUCKET, FEW = 0.25, 1 << 21, 8
_LOW40 = (1 << 40) - 1

_K = BANDS * ROWS
_A = mix(np.arange(1, _K + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_B = mix(np.arange(1001, 1001 + _K, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BAND = mix(np.arange(5001, 5001 + BANDS, dtype=U64))
_ROW = mix(np.arange(9001, 9001 + ROWS, dtype=U64)) | U64(1)
_EDGES = (np.arange(_K, dtype=np.float64) * (2.0**64 / _K)).astype(U64)


def _bands(values: np.ndarray, salt: int) -> np.ndarray:
    return mix((mix(values).reshape(BANDS, ROWS) * _ROW).sum(1, dtype=U64) + _BAND + U64(salt))


def band_keys(s: np.ndarray, threshold: float) -> np.ndarray:
    """The keys of a sorted set; nearly all similar sets share one, the others are left to `pair_keys`. Sets near SMALL have the keys of both kinds."""
    keys = []
    if len(s) <= SMALL / threshold:
        low = np.full(_K, np.iinfo(np.uint64).max, U64)
        for at in range(0, len(s), 64):
            np.minimum(low, (s[None, at : at + 64] * _A[:, None] + _B[:, None]).min(1), out=low)
        keys.append(_bands(low, 1))
    if len(s) > SMALL:
        first = np.searchsorted(s, _EDGES)
        end = np.append(first[1:], len(s))
        filled = end > first
        # an empty bin takes the value of the next that isn't, and how far it is
        at = np.flatnonzero(filled)
        to = at[np.searchsorted(at, np.arange(_K)) % len(at)]
        far = (to - np.arange(_K)) % _K
        keys.append(_bands(s[first[to]] + far.astype(U64) * U64(0xD6E8FEB86659FD93), 2))
    return np.concatenate(keys)


def pair_keys(s: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """The keys of a sorted set with an order of its n-grams; sets of a similarity of `threshold` always share one.

    A space is for pairs whose larger set has from m up to 2 m n-grams, m a power of two. Such a pair has an overlap of at least o, so in an order that all
    sets have in common its first l common n-grams are among the first size - o + l of either set. These go by hash into l - 1 groups, so
    some group has two of them: the keys are the pairs within groups (single n-grams where l is 1). Rare n-grams come first.
    """
    size = len(s)
    by = np.lexsort((s, rank))
    m, out, own = 1 << (size.bit_length() - 1), [], True
    while size >= threshold * m - 1e-9:
        least = math.ceil(threshold * m - 1e-9)
        common = max(min(2, least), min(least, round(COMMON * m)))
        overlap = threshold * size if own else threshold / (1 + threshold) * (size + m)
        r = s[by[: size - math.ceil(overlap - 1e-9) + common]]
        if common == 1:
            out.append(mix(r + U64(m)))
        else:
            group = mix(r ^ U64(99)) % U64(common - 1)
            to = np.lexsort((r, group))
            group, h = group[to], mix(r[to])
            one, two = h * U64(3), h * U64(0x9E3779B97F4A7C15) + U64(m)
            for d in range(1, len(r)):
                same = np.flatnonzero(group[d:] == group[:-d])
                if not len(same):
                    break
                out.append(mix(one[same] + two[same + d]))
        m, own = 2 * m, False
    return np.concatenate(out) if out else np.zeros(0, U64)


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 1 bits an n-gram: whether an odd number of n-grams falls on the bit. Two sets differ in at least as many n-grams as bits."""
    bits = max(64, 2 << (len(s).bit_length() - 1))
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def near(one: tuple, two: tuple, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) of the sets, given as arrays (cell, size, list of parity bitmaps), of different cells that can be similar by sizes and bitmaps."""
    words = [np.array([len(b) for b in side[2]]) for side in (one, two)]
    most = (1 - threshold) / (1 + threshold)
    for wx in np.unique(words[0]):
        xs = np.flatnonzero(words[0] == wx)
        bx = np.stack([one[2][k] for k in xs])
        for wy in np.unique(words[1]):
            ys = np.flatnonzero(words[1] == wy)
            by = np.stack([two[2][k] for k in ys])
            w = min(wx, wy)
            ax, ay = _folded(bx, w), _folded(by, w)
            cells, sizes = two[0][ys], two[1][ys]
            for k, x in enumerate(xs):
                size = one[1][x]
                at = np.flatnonzero((cells != one[0][x]) & (np.minimum(size, sizes) >= threshold * np.maximum(size, sizes) - 1e-9))
                if len(at):
                    apart = np.bitwise_count(ay[at] ^ ax[k]).sum(1, dtype=np.int64)
                    at = at[apart <= most * (size + sizes[at]) + 1e-9]
                if len(at):
                    yield int(x), ys[at]


def _counts(n: int):
    """For mapInArrow over (text): how many texts of the partition have each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [s for batch in batches for _, s in gram_sets(batch.column(0), n)]
        if sets:
            g, c = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c)], ["g", "c"])

    return run


def _bytes(keys: np.ndarray) -> np.ndarray:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _read(blobs: list[bytes]) -> np.ndarray:
    low = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :5] = low
    return out.reshape(-1).view("<i8")


def _keyed(n: int, threshold: float, buckets: int, frequent: np.ndarray, often: np.ndarray):
    """For mapInArrow over (text): the keys of the texts by bucket, as rows (bucket, keys, texts), 5 bytes a key and 5 of the text's print."""

    def flushed(keys: list, ids: list) -> pa.RecordBatch:
        k = np.concatenate(keys)
        who = np.repeat(np.array([i for i, _ in ids], U64), [c for _, c in ids])
        bucket = ((k >> U64(40)) % U64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        bucket, k, who = bucket[by], _bytes(k[by]), _bytes(who[by])
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(first[1:], len(bucket))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), *(pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in (k, who))], ["bucket", "keys", "ids"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            for _, s in gram_sets(batch.column(0), n):
                if not len(s):
                    continue
                rank = np.zeros(len(s), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    rank = np.where(frequent[at] == s, often[at], 0)
                k = pair_keys(s, rank, threshold)
                keys.append(k)
                ids.append((prints(s)[0] & _LOW40, len(k)))
                held += len(k)
                if held > 1 << 20:
                    yield flushed(keys, ids)
                    keys, ids, held = [], [], 0
        if held:
            yield flushed(keys, ids)

    return run


def _shared(key, group):
    """For applyInArrow over a bucket: (g, id) of the texts that share a key; those of a key of up to FEW texts as pairs, each once."""
    keys, ids = _read(group.column("keys").to_pylist()), _read(group.column("ids").to_pylist())
    by = np.argsort(keys)
    keys, ids = keys[by], ids[by]
    same = keys[1:] == keys[:-1]
    some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    keys, ids = keys[some], ids[some]
    by = np.lexsort((ids, keys))
    keys, ids = keys[by], ids[by]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    many = np.diff(np.append(first, len(keys)))
    pairs = np.zeros((0, 2), np.int64)
    for size in range(2, FEW + 1):
        at = first[many == size]
        if len(at):
            one, two = np.triu_indices(size, 1)
            pairs = np.concatenate([pairs, np.stack([ids[at[:, None] + one].reshape(-1), ids[at[:, None] + two].reshape(-1)], 1)])
    pairs = np.unique(pairs, axis=0)
    g = -(mix(mix(pairs[:, 0].astype(U64)) + pairs[:, 1].astype(U64)) >> U64(1)).astype(np.int64) - 1
    hot = np.repeat(many > FEW, many)
    return pa.table(
        {"g": np.concatenate([g, g, keys[hot] | (key[0].as_py() << 40)]), "id": np.concatenate([pairs[:, 0], pairs[:, 1], ids[hot]])},
        pa.schema([("g", pa.int64()), ("id", pa.int64())]),
    )


def _met(threshold: float):
    """For mapInArrow over partitions sorted by (g, p, q): (u, v) of the texts of each that can be similar."""

    def solve(p, q, rows) -> list[tuple[np.ndarray, np.ndarray]]:
        def side(part):
            mine = [r for r in rows if r[1] == part]
            return np.array([r[0] for r in mine], np.int64), (np.array([r[2] for r in mine], np.int64), np.array([r[3] for r in mine], np.int64), [np.frombuffer(r[4], U64) for r in mine])

        u, one = side(p)
        v, two = (u, one) if p == q else side(q)
        return [(np.full(len(j), u[i]), v[j]) for i, j in near(one, two, threshold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for g, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, p, q) != key:
                    if len(rows) > 1:
                        out += solve(*key[1:], rows)
                    key, rows = (g, p, q), []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(2)], ["u", "v"])
                out = []
        if len(rows) > 1:
            out += solve(*key[1:], rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(2)], ["u", "v"])

    return run


def _sketch(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, keys, bits = [], [], [], [], []
            for _, s in gram_sets(batch.column(1), n):
                size.append(len(s))
                a, b = prints(s) if len(s) else (0, 0)
                one.append(a)
                two.append(b)
                keys.append(band_keys(s, threshold).view(np.int64) if len(s) else [])
                bits.append(parity(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "k", "n", "f1", "f2", "keys", "bits"],
            )

    return run


def prints(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same for equal sets."""
    one = mix(s + U64(17)).sum(dtype=U64)
    two = mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    return int(one.view(np.int64)), int(two.view(np.int64))


class Tree:
    """Levels of nodes over sets in the order of their sizes, from the leaves up."""

    def __init__(self, sets: list[np.ndarray], words: int):
        bits = np.zeros((len(sets), words), U64)
        shift = U64(64 - (words * 64 - 1).bit_length())
        for k, s in enumerate(sets):
            b = np.unique(s >> shift)
            np.bitwise_or.at(bits[k], (b >> U64(6)).astype(np.int64), U64(1) << (b & U64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        over = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, over)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, over = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(over, at),
                )
            )


def tree_pairs(one: Tree, two: Tree | None, threshold: float, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of leaves that the dual traversal leaves; two None: pairs i < j within one."""
    other = two or one
    depth = max(len(one.levels), len(other.levels))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(depth - 1, -1, -1):
        a = one.levels[min(level, len(one.levels) - 1)]
        b = other.levels[min(level, len(other.levels) - 1)]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), block):
            x, y = i[at : at + block], j[at : at + block]
            shared = np.bitwise_count(a[0][x] & b[0][y]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(a[2][x], b[2][y]), shared + np.minimum(a[3][x], b[3][y]))
            least = np.maximum(a[1][x], most) + np.maximum(b[1][y], most) - most
            keep[at : at + block] = most >= threshold * least - 1e-9
        i, j = i[keep], j[keep]
        if not level:
            break

        def children(k, tree):
            below, here = level - 1, min(level, len(tree.levels) - 1)
            if below >= len(tree.levels) - 1 and here == len(tree.levels) - 1 and level > here:
                return k[:, None], np.ones((len(k), 1), bool)
            c = k[:, None] * FAN + np.arange(FAN)
            return c, c < len(tree.levels[below][1])

        ci, oi = children(i, one)
        cj, oj = children(j, other)
        x = np.broadcast_to(ci[:, :, None], (len(i), ci.shape[1], cj.shape[1]))
        y = np.broadcast_to(cj[:, None, :], x.shape)
        ok = oi[:, :, None] & oj[:, None, :]
        if two is None:
            ok = ok & (x <= y)
        i, j = x[ok], y[ok]
    if two is None:
        i, j = i[i < j], j[i < j]
    return i, j


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, all j, their similarities) of the sets i with similar ones: of left with right, or within left (each pair once)."""
    both = left + (right or [])
    if not left or right is not None and not right:
        return
    middle = float(np.median([len(s) for s in both]))
    words = max(8, min(256, 1 << int(np.ceil(np.log2(max(middle, 1) * 4 / 64 + 1)))))
    order = np.array(sorted(range(len(left)), key=lambda k: (len(left[k]), left[k][0])))
    one = Tree([left[k] for k in order], words)
    if right is None:
        back, two = order, None
    else:
        back = np.array(sorted(range(len(right)), key=lambda k: (len(right[k]), right[k][0])))
        two = Tree([right[k] for k in back], words)
    i, j = tree_pairs(one, two, threshold)
    if not len(i):
        return
    names, ids = np.unique(np.concatenate(both), return_inverse=True)
    ends = np.cumsum([0] + [len(s) for s in both])
    parts = [ids[ends[k] : ends[k + 1]] for k in range(len(both))]
    flag = np.zeros(len(names), bool)
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        x = int(order[i[a]])
        flag[parts[x]] = True
        ys = back[j[a:b]]
        rows = [parts[y if right is None else len(left) + y] for y in ys]
        sizes = np.array([len(r) for r in rows])
        shared = np.add.reduceat(flag[np.concatenate(rows)].astype(np.int64), np.cumsum(sizes) - sizes)
        flag[parts[x]] = False
        value = shared / (sizes + len(parts[x]) - shared)
        good = value >= threshold
        if good.any():
            yield x, ys[good], value[good]


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float):
    """(i, j, similarity) of all similar pairs of sets."""
    return [(x, int(y), float(v)) for x, ys, values in similar(left, right, threshold) for y, v in zip(ys, values)]


class _Groups:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _cells(n: int, threshold: float, pairs: bool):
    """For mapInArrow over partitions sorted by (cell, p, q, u): the similar pairs of each task, or (u, low, links) of each text with some."""

    def solve(key, rows):
        rows.sort()
        sets = dict(gram_sets(pa.array([r[3] for r in rows], pa.large_string()), n))
        mine = [k for k, r in enumerate(rows) if r[1] == key[1]]
        other = None if key[1] == key[2] else [k for k, r in enumerate(rows) if r[1] == key[2]]
        got = similar([sets[k] for k in mine], None if other is None else [sets[k] for k in other], threshold)
        mine, other = np.array(mine), np.array(mine if other is None else other)
        copies, groups = np.array([r[2] for r in rows], np.int64), _Groups(len(rows))
        links, u = np.zeros(len(rows), np.int64), np.array([r[0] for r in rows], np.int64)
        for x, ys, values in got:
            x, ys = int(mine[x]), other[ys]
            if pairs:
                yield np.minimum(u[x], u[ys]), np.maximum(u[x], u[ys]), values
                continue
            links[x] += copies[ys].sum()
            links[ys] += copies[x]
            for y in ys:
                groups.join(x, int(y))
        on = np.flatnonzero(links)
        if len(on):
            yield u[on], u[[groups.find(int(x)) for x in on]], links[on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "jaccard"] if pairs else ["u", "low", "links"]
        key, rows = None, []

        def batches_of(key, rows):
            if len(rows) > 1:
                out = list(solve(key, rows))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(3)], names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for cell, p, q, u, part, copies, text in zip(*columns):
                if (cell, p, q) != key:
                    yield from batches_of(key, rows)
                    key, rows = (cell, p, q), []
                rows.append((u, part, copies, text))
        yield from batches_of(key, rows)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column hasn't come before in the partition."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for u in batch.column(0).to_pylist():
            keep.append(u not in seen)
            seen.add(u)
        yield batch.filter(pa.array(keep, pa.bool_()))


class _Join:
    """The tables of the join. rows (doc_id, n, u): every row with the row that stands for its text, null if it has no n-grams;
    texts (u, leader, copies); found: pairs of texts, or (u, low, links) of those with a similar one."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, part: int, pairs: bool):
        texts = docs.select("doc_id", F.lower("text").alias("text"), F.xxhash64("doc_id", "text").alias("k"))
        kind = kind_of(docs, "doc_id")
        sketches = texts.mapInArrow(_sketch(n, threshold), f"doc_id {kind}, k bigint, n int, f1 bigint, f2 bigint, keys array<bigint>, bits binary")
        sketches = written(sketches.withColumn("row", F.monotonically_increasing_id()))
        some = sketches.where("n > 0")
        self.texts = written(
            some.groupBy("f1", "f2").agg(F.min("row").alias("u"), F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
        )
        self.rows = written(
            some.select("doc_id", "f1", "f2").join(self.texts.select("f1", "f2", "u"), ["f1", "f2"]).select("doc_id", "u")
        )
        self.empty = sketches.where("n = 0").select("doc_id")
        heads = some.select("row", "k", "n", "keys").join(self.texts.select(F.col("u").alias("row"), "copies"), "row")
        keys = heads.select(F.col("row").alias("u"), F.explode("keys").alias("key"))
        low = keys.groupBy("key").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low != high").drop("high")
        cells = connected_components(keys.join(low, "key").where("u != low").select("u", F.col("low").alias("v")))
        missed = written(self._missed(texts, some, cells, n, threshold, part))
        if not missed.isEmpty():
            cells = connected_components(cells.toDF("u", "v").unionByName(missed))
        self.found = written(self._tasks(texts, heads, cells, threshold, part).mapInArrow(
            _cells(n, threshold, pairs), "a bigint, b bigint, jaccard double" if pairs else "u bigint, low bigint, links bigint"
        ))

    def _missed(self, texts: DataFrame, some: DataFrame, cells: DataFrame, n: int, threshold: float, part: int) -> DataFrame:
        """(u, v): the pairs of texts of different cells that can be similar, none left out."""
        rows, grams = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        one_in = max(1, math.ceil(rows / SAMPLE))
        sample = texts.where(F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(one_in)) == 0).select("text").mapInArrow(_counts(n), "g bigint, c bigint")
        top = sample.groupBy("g").agg(F.sum("c").alias("c")).where("c > 1").orderBy(F.desc("c"), "g").limit(FREQUENT).toArrow()
        frequent, often = top.column("g").to_numpy().view(U64), top.column("c").to_numpy()
        by = np.argsort(frequent)
        keyed = texts.select("text").mapInArrow(_keyed(n, threshold, max(1, math.ceil(grams / BUCKET)), frequent[by], often[by]), "bucket int, keys binary, ids binary")
        shared = written(keyed.groupBy("bucket").applyInArrow(_shared, "g bigint, id bigint"))
        texts_of = (
            self.texts.select("u", "n", F.col("f1").bitwiseAND(F.lit(_LOW40)).alias("id"))
            .join(cells.toDF("u", "cell"), "u", "left").withColumn("cell", F.coalesce("cell", "u"))
        )
        # keys within one cell have nothing to add
        members = cut(shared.distinct().join(texts_of, "id").select("g", "u", "cell", "n"))
        across = members.groupBy("g").agg(F.min("cell").alias("low"), F.max("cell").alias("high"), F.ceil(F.count(F.lit(1)) / part).cast("int").alias("m")).where("low != high").select("g", "m")
        return (
            members.join(across, "g").join(some.select(F.col("row").alias("u"), "bits"), "u")
            .withColumn("part", F.pmod(F.xxhash64("u"), F.col("m")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            .select("g", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "u", "part", "cell", "n", "bits")
            .repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
            .mapInArrow(_met(threshold), "u bigint, v bigint")
        )

    def _tasks(self, texts: DataFrame, heads: DataFrame, cells: DataFrame, threshold: float, part: int) -> DataFrame:
        # classes of size: similar texts are of the same or of neighbouring ones
        wide = math.log(1.0001 / threshold)
        members = cut(
            cells.toDF("u", "cell").join(heads.select(F.col("row").alias("u"), "k", "n", "copies"), "u")
            .withColumn("b", F.floor(F.log("n") / wide).cast("int")).drop("n")
        )
        sizes = members.groupBy("cell", "b").count()
        total = sizes.groupBy("cell").agg(
            F.sum("count").alias("all"), F.map_from_entries(F.collect_list(F.struct("b", F.ceil(F.col("count") / part).cast("int").alias("parts")))).alias("m")
        )  # a class for each power of 1 / threshold: some dozens
        big = total.where(F.col("all") > part).drop("all")
        mine = F.pmod(F.xxhash64("u"), F.col("m")[F.col("b")]).cast("int")
        tasks = F.flatten(
            F.transform(
                F.array(F.lit(-1), F.lit(0), F.lit(1)),
                lambda d: F.transform(
                    F.when(F.map_contains_key("m", F.col("b") + d), F.sequence(F.lit(0), F.element_at("m", F.col("b") + d) - 1)).otherwise(F.array().cast("array<int>")),
                    lambda k: (F.col("b") + d).cast("bigint") * F.lit(2**31) + k,
                ),
            )
        )
        own = F.when(F.col("m").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("b").cast("bigint") * F.lit(2**31) + mine)
        placed = (
            members.join(big, "cell", "left")
            .withColumn("part", own)
            .withColumn("others", F.when(F.col("m").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(tasks))
            .select("u", "k", "cell", "copies", "part", "others")
        )
        return (
            texts.where("text is not null").select("k", "text").join(placed, "k")
            .select("u", "cell", "part", "copies", "text", "others")
            .mapInArrow(_once, "u bigint, cell bigint, part bigint, copies bigint, text string, others array<bigint>")
            .withColumn("o", F.explode("others"))
            .select("cell", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "u", "part", "copies", "text")
            .repartition("cell", "p", "q")
            .sortWithinPartitions("cell", "p", "q")
        )


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(text_a, text_b, jaccard): all pairs of different texts of at least `threshold`, rounded to 6 decimals; (doc_id, text_id): the text of each row.

    Copies, rows of equal n-gram sets, are one text and aren't expanded into pairs. Nulls, empty texts and repeated rows as in
    `jaccard_classes`; rows without n-grams have a null text_id. The number of pairs can grow as the square of a group.
    """
    j = _Join(docs, n, threshold, part, True)
    pairs = j.found.select(F.col("a").alias("text_a"), F.col("b").alias("text_b"), F.round("jaccard", 6).alias("jaccard"))
    none = j.empty.select("doc_id", F.lit(None).cast("bigint").alias("text_id"))
    return pairs, j.rows.select("doc_id", F.col("u").alias("text_id")).unionByName(none)


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """(doc_id, class_id, links) of each row: the least doc_id of its class, and the number of other rows that it is similar to.

    Classes are connected by links, that is by pairs of rows of a similarity of at least `threshold`; copies count as links. `docs` (doc_id, text, ...);
    doc_id is of any type that can be ordered; other columns are ignored, whatever their names. Every row has its row in the result. A text of fewer than n tokens has one n-gram,
    all its tokens; null and empty texts and those without tokens have none: their class is their own id, without links. A null doc_id
    is never the least (a class of no other ids has null). Rows that repeat a doc_id are in one class. Texts are read
    whole; no partner is left out for their number. Empty tables give no rows. The work is done when this is called; its result
    reads tables in the shared folder.
    """
    j = _Join(docs, n, threshold, part, False)
    # rows of one doc_id with different texts belong together
    ids = j.rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("u").alias("v"), F.max("u").alias("high")).where("v != high").select(F.col("doc_id").alias("same"), "v")
    same = j.rows.join(ids, F.col("doc_id") == F.col("same")).where("u != v").select("u", "v")
    links = j.found.groupBy("u").agg(F.sum("links").alias("links"))
    groups = connected_components(j.found.select("u", F.col("low").alias("v")).unionByName(same)).toDF("u", "root")
    least = groups.join(j.texts.select("u", "leader"), "u").groupBy("root").agg(F.min("leader").alias("class_id"))
    classed = groups.join(least, "root").select("u", "class_id")
    info = (
        j.texts.select("u", "leader", "copies").join(classed, "u", "left").join(links, "u", "left")
        .select("u", F.when(F.col("class_id").isNull(), F.col("leader")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    alone = j.empty.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return j.rows.join(info, "u").select("doc_id", "class_id", "links").unionByName(alone)


def drop_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """`docs` with one document of each class, that of the least doc_id; same columns.

    Rows of null doc_id, of null and empty texts and without tokens stay; rows that repeat a doc_id stay or go together. Columns of any
    name go along. An empty table gives an empty table.
    """
    (gone,) = fresh(docs, "gone")
    ids = jaccard_classes(docs, n, threshold, part).where("doc_id != class_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, docs["doc_id"] == ids[gone], "left_anti")


ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {N} THEN list_distinct(list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i : i + {N - 1}], ' ')))
    ELSE [array_to_string(w, ' ')] END AS s FROM words WHERE len(w) > 0
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n >= {THRESHOLD} * b.n AND b.n >= {THRESHOLD} * a.n
  GROUP BY a.doc_id, b.doc_id
), pairs AS (
  SELECT doc_a, doc_b FROM shared WHERE k / CAST(na + nb - k AS DOUBLE) >= {THRESHOLD}
), linked AS (
  SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs
), reach AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
)
SELECT d.doc_id, coalesce(least(d.doc_id, low), d.doc_id) AS class_id, coalesce(n, 0) AS links FROM documents d
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) AS r ON d.doc_id = r.a LEFT JOIN (SELECT a, count(*) AS n FROM linked GROUP BY a) AS l ON d.doc_id = l.a
"""
