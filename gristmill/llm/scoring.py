"""Language-model scoring by online logistic context mixing, in bits per byte.

Predictors. Three know the corpus: tables that say, for the last 2, 3 and 5 bytes, hashed, which byte follows. One knows only the document: the byte that followed the last 4 bytes the
last time that they occurred in it, if they did; it is checked against these bytes, so that no other context stands in for them. Its say grows and shrinks with how often it was right in this context, and
by what it has done in this document so far.

Corpus. One pass counts, for every byte, which byte follows its contexts. The rows are in two halves by their hashed id, and a document is scored with the counts of the half that it isn't
in: no document predicts itself. Each task counts into arrays and sends them sparsely, in blocks; blocks are added up by
key, so what is gathered grows with the corpus, as does the number of context slots (`slot_bits`). The sums are
written to one file in the shared folder, which the tasks map instead of holding it. A slot's counts give one prediction for each of the eight binary decisions that spell a byte: the logarithm of
the odds, in a table of 8-bit numbers.

Mixing. A text is coded bit by bit, from its first byte to its last. The predictions are summed with weights;
the gate that selects the weights is the place of the bit in its byte, and for the document's own predictor how often it was right in the context. After each bit the weights move along
the gradient of the coding cost. The mixed prediction is refined by averaging it with an adaptive map from
its own quantised value to what followed in this text. The cost is the sum of -log2 of the probability given to each bit that came.

A document is one lane from its first byte to its last, so weights, map and history are carried through all of it. Lanes of
like length go together, thousands coded in step by array operations, and the result is the same however the
rows are partitioned.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, shared_folder
from .kernels import slices

ORDERS, HALVES, HISTORY = (2, 3, 5), 2, 4
LANES, PAD = 6144, 8
RUNS, FIRST_TRUST = 8, 1.0  # classes of how often the history was right in a row; its first weight
LEAST_BITS, DENSE_BITS = 10, 16  # up to DENSE_BITS a task counts in whole arrays
HELD = 4_000_000  # counters of an order that a task holds beyond them
GROUP_BYTES, BUCKET_BYTES, SHORT_CLASS = 60_000_000, 30_000_000, 11  # a group has under 2**26 bytes
RATE, MAP_RATE, FIRST_WEIGHT = 0.02, 0.02, 0.35
SCALE, HALF = 16.0, 0.4  # table units per unit of log odds; what is added to counts
AHEAD = 1 << 11  # lanes times steps whose predictions are looked up at once
BLOCK = 1 << 14  # counters in a row of the gathered statistics

def _places() -> np.ndarray:
    """Where the nodes of a byte's decisions are in its slot: rows of ROW entries, the first for its first four bits, then one for each of these for its last four."""
    place = np.arange(256)
    for node in range(16, 256):
        depth = node.bit_length() - 5
        place[node] = ROW * (1 + (node >> depth & 15)) + ((1 << depth) | (node & (1 << depth) - 1))
    return place


ROW = 16
ENTRIES = 17 * ROW  # of a slot
PLACE = _places()
#: By bit and byte, the place in its row of the node before the bit.
_SUBS = np.stack([PLACE[(np.arange(256) | 256) >> (8 - k)] % ROW for k in range(8)])
_M = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)]


def slot_bits(total_bytes: int) -> int:
    """The number of context slots of each order grows with the corpus, without an end."""
    return max(LEAST_BITS, math.ceil(math.log2(max(total_bytes, 1))) - 14)


def contexts(rows: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The slot of each order (uint32 arrays) from the bytes before, nearest first."""
    out, h = [], np.zeros_like(rows[0], dtype=np.uint32)
    for k in range(max(ORDERS)):
        h += np.multiply(rows[k], _M[k], dtype=np.uint32)
        h += _M[k]
        if k + 1 in ORDERS:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x2C1B3C6D)
            out.append(x >> np.uint32(32 - bits))
    return out


def _blocks(order: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows (order, block, places, counts) of sorted distinct counters."""
    block = (keys // BLOCK).astype(np.int64)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    place, counts = (keys % BLOCK).astype(np.uint16), counts.astype(np.uint32)
    return [(order, int(block[a]), place[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(first, np.append(first[1:], len(keys)))]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] + 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counted(bits: int):
    """For mapInArrow over (half, text): the partition's counts, as rows (order and half, block, places, counts); a block may come more than once."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["o", "block", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, many = bits <= DENSE_BITS, len(ORDERS)
        totals = [np.zeros(256 << bits if dense else 0, np.uint32) for _ in range(HALVES * many)]
        held: list[list] = [[] for _ in totals]
        one = np.uint32(1)
        for batch in batches:
            halves = batch.column(0).to_numpy()
            for half in range(HALVES):
                for _, _, buf, offs in slices(batch.column(1).filter(pa.array(halves == half)), 500_000):
                    n, lengths = len(offs) - 1, np.diff(offs)
                    padded = np.zeros(len(buf) + PAD * n, np.uint8)
                    at = np.arange(len(buf)) + PAD * np.repeat(np.arange(1, n + 1), lengths)
                    padded[at] = buf
                    at -= PAD
                    before = [padded[PAD - k : len(padded) - k] for k in range(1, max(ORDERS) + 1)]
                    for k, slot in enumerate(contexts(before, bits)):
                        order, slot = half * many + k, slot[at]
                        if dense:
                            np.add.at(totals[order], (slot << np.uint32(8)) | buf, one)
                            continue
                        held[order].append(np.unique((slot.astype(np.int64) << 8) | buf, return_counts=True))
                        if sum(len(x) for x, _ in held[order]) > HELD:
                            held[order] = [_merged(held[order])]
                            if len(held[order][0][0]) > HELD // 2:
                                yield batch_of(_blocks(order, *held[order].pop()))
        for order, total in enumerate(totals):
            if dense:
                keys = np.flatnonzero(total)
                yield batch_of(_blocks(order, keys, total[keys]))
            elif held[order]:
                yield batch_of(_blocks(order, *_merged(held[order])))

    return run


def odds(counts: np.ndarray) -> np.ndarray:
    """Of counts by (slot, byte), the table entries by (slot, place of the node).

    Node 1 is the first bit, 2n + bit follows n; one row of entries is read for either half of a byte.
    """
    slots = len(counts)
    out = np.zeros((slots, ENTRIES), np.int8)
    for depth in range(8):
        pair = counts.reshape(slots, 1 << depth, 2, 128 >> depth).sum(3)
        value = np.log((pair[:, :, 1] + HALF) / (pair[:, :, 0] + HALF)) * SCALE
        out[:, PLACE[1 << depth : 2 << depth]] = np.clip(np.rint(value), -127, 127).astype(np.int8)
    return out


def _added(path: str, bits: int):
    """For applyInArrow: writes the table entries of one block to their place in the file."""

    def run(key, group):
        total = np.zeros(BLOCK, np.float64)
        for places, counts in zip(group.column("places").to_pylist(), group.column("counts").to_pylist()):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        file = os.open(path, os.O_WRONLY)
        try:
            os.pwrite(file, odds(total.reshape(-1, 256)).tobytes(), (key[0].as_py() << bits) * ENTRIES + key[1].as_py() * (BLOCK // 256) * ENTRIES)
        finally:
            os.close(file)
        return pa.table({"blocks": pa.array([1], pa.int64())})

    return run


def half_of(docs: DataFrame):
    """The half of the corpus that a row is in, by its hashed id; rows that repeat an id are in one."""
    return F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(HALVES)).cast("int")


def mapped(path: str, bits: int) -> np.ndarray:
    return np.asarray(np.memmap(path, np.int8, "r", shape=(HALVES * len(ORDERS), ENTRIES << bits)))


def table_file(docs: DataFrame, bits: int) -> str:
    """Of a file in the shared folder with the entries of all orders' tables, from all texts of `docs`; all executors have to have the folder mounted."""
    folder = shared_folder(docs.sparkSession).removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for the tables of scoring (got {folder})")
    path = f"/{folder.lstrip('/')}/gristmill-{uuid.uuid4().hex}.tables"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.truncate(HALVES * len(ORDERS) * (ENTRIES << bits))  # a block without counts stays 0
    counted = docs.select(half_of(docs).alias("half"), "text").mapInArrow(_counted(bits), "o int, block int, places binary, counts binary")
    counted.groupBy("o", "block").applyInArrow(_added(path, bits), "blocks bigint").agg(F.sum("blocks")).collect()
    return path


def corpus_tables(docs: DataFrame, bits: int) -> np.ndarray:
    """The entries of all orders' tables of either half, from all texts of `docs`; (halves * orders, 2**bits * ENTRIES), mapped from the shared folder."""
    return mapped(table_file(docs, bits), bits)


def history(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte, class) for every byte of the texts, one after another: what followed its HISTORY bytes of context the last time in the same text, and how often in a row, up to RUNS - 1, that
    was right in this context before; class RUNS where the context is new."""
    byte, kind, some, size, at = [], [], [], 0, 0
    for t in texts:
        if some and (size + len(t) > 1 << 19 or len(some) == 4096):
            byte_, kind_ = _history(some)
            byte.append(byte_)
            kind.append(kind_)
            some, size = [], 0
        some.append(t)
        size += len(t)
    byte_, kind_ = _history(some)
    return np.concatenate([*byte, byte_]), np.concatenate([*kind, kind_])


def _history(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that fit in 20 bits of places, or of one alone."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    byte, kind = np.zeros(n, np.uint8), np.full(n, RUNS, np.uint8)
    if n <= HISTORY:
        return byte, kind
    wide = buf.astype(np.uint32)
    context = (wide[:-4] << np.uint32(24)) | (wide[1:-3] << np.uint32(16)) | (wide[2:-2] << np.uint32(8)) | wide[3:-1]  # before byte 4, 5, ...
    bits = 20 if len(texts) > 1 else 32
    key = (context.astype(np.uint64) << np.uint64(bits)) | np.arange(HISTORY, n, dtype=np.uint64)
    if len(texts) > 1:
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        key |= np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(52), lengths)[HISTORY:]
        first = (ends - lengths)[1:, None] + np.arange(HISTORY) - HISTORY  # contexts that reach into the text before
        drop = np.unique(first[(first >= 0) & (first < n - HISTORY)])
        key = np.delete(key, drop)
    key.sort()
    at = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    key >>= np.uint64(bits)
    same = np.zeros(len(at), bool)
    np.equal(key[1:], key[:-1], out=same[1:])
    came = buf[at]
    said = np.zeros(len(at), np.uint8)
    said[1:] = came[:-1]
    right = same & (said == came)
    # how many right ones stand in a row before
    place = np.arange(len(at), dtype=np.int32)
    wrong = np.maximum.accumulate(np.where(right, np.int32(-1), place))
    run = np.zeros(len(at), np.int32)
    run[1:] = place[:-1] - wrong[:-1]
    byte[at] = said
    kind[at] = np.where(same, np.minimum(run, RUNS - 1), RUNS).astype(np.uint8)
    return byte, kind


def code_texts(texts: list[bytes], halves: np.ndarray, tables: np.ndarray, bits: int) -> np.ndarray:
    """The cost in bits of each of texts, longest first, given the half of the corpus that each is in."""
    lanes = len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    width = int(length[0])
    block, guess = np.zeros((PAD + width, lanes), np.uint8), np.zeros((width, lanes), np.uint8)
    kinds = np.full((width, lanes), RUNS, np.uint8)
    said, kind = history(texts)
    at = 0
    for k, t in enumerate(texts):
        block[PAD : PAD + len(t), k] = np.frombuffer(t, np.uint8)
        guess[: len(t), k], kinds[: len(t), k] = said[at : at + len(t)], kind[at : at + len(t)]
        at += len(t)
    rows = np.ascontiguousarray(tables).reshape(-1).view(np.complex128)  # ROW entries each
    many = len(ORDERS)
    start = (np.arange(many, dtype=np.int64)[:, None] + (1 - np.asarray(halves, np.int64)) * many) * (17 << bits)
    # The document's own predictor is the last row, in units of the tables; its weight is one for all bits of a byte. Weights are doubled, so their sum
    # says the place in the map; probabilities p are held as 2 p - 1, for one that is the tangent of a quarter of the sum.
    weights = [np.full((many + 1, lanes), 2 * FIRST_WEIGHT / SCALE, np.float32) for _ in range(8)]
    trust = np.zeros((lanes, RUNS + 1), np.float32)
    trust[:, :RUNS] = 2 * FIRST_TRUST / SCALE * np.log1p(np.arange(1, RUNS + 1))
    trust = trust.reshape(-1)
    trust_at = np.arange(lanes, dtype=np.int64) * (RUNS + 1)
    maps = np.tile(np.tanh(np.linspace(-4, 4, 33)).astype(np.float32), lanes)
    map_at = np.arange(lanes, dtype=np.float32) * 33 + 16  # exact, as lanes are few
    cost = np.zeros(lanes, np.float64)
    rate, keep_rate = np.float32(RATE / SCALE / SCALE), np.float32(1 - MAP_RATE)
    quarter, two, top = np.float32(0.25), np.float32(2), np.float32(16)
    live = np.searchsorted(-length, -np.arange(width) - 0.5, "right")  # lanes longer than p
    one_or_minus = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).T.copy()
    # by bit and difference of guess and byte: SCALE as long as they agree, less than 0 where they first don't, then 0; with 256 more, that there is no guess, 0
    agree = np.zeros((8, 512), np.float32)
    for d in range(256):
        agree[: 8 - d.bit_length(), d] = SCALE
        if d:
            agree[8 - d.bit_length(), d] = -SCALE
    most = 8 * many * max(lanes, AHEAD)
    places, raw, odd = np.empty(most, np.int64), np.empty(most, np.int8), np.empty(most + most // many, np.float32)
    got, lane_at = np.empty(most // 4, np.complex128), np.arange(most // 4, dtype=np.int64) * ROW
    last, p = -1, 0
    while p < width:
        n = int(live[p])
        # all that doesn't hang on the coding of the bytes before is looked up for some steps of as many lanes at once
        steps = min(int(np.searchsorted(-live, -n, "right")) - p, max(1, AHEAD // n))
        if n != last:
            last = n
            z, prob, good, place, final = (np.empty(n, np.float32) for _ in range(5))
            where = np.empty(n, np.int64)
            here, trusted = map_at[:n], trust_at[:n]
            weights = [np.ascontiguousarray(w[:, :n]) for w in weights]
        row = PAD + p
        now = block[row : row + steps, :n]
        byte = now.astype(np.int64)
        size = many * steps * n
        base = places[: 2 * size].reshape(2, many, steps, n)
        for k, slot in enumerate(contexts([block[row - k : row - k + steps, :n] for k in range(1, max(ORDERS) + 1)], bits)):
            np.multiply(slot, 17, out=base[0, k], dtype=np.int64)
        base[0] += start[:, None, :n]
        np.add(base[0], 1 + (now >> 4), out=base[1])
        np.take(rows, base.reshape(-1), out=got[: 2 * size], mode="clip")
        at = places[: 8 * size].reshape(2, 4, many, steps, n)
        np.add(lane_at[: 2 * size].reshape(2, 1, many, steps, n), _SUBS.take(byte, axis=1).reshape(2, 4, 1, steps, n), out=at)
        np.take(got.view(np.int8), at.reshape(-1), out=raw[: 8 * size], mode="clip")
        t = odd[: 8 * (many + 1) * steps * n].reshape(8, many + 1, steps, n)
        t[:, :many] = raw[: 8 * size].reshape(8, many, steps, n)
        hits = one_or_minus.take(byte, axis=1)  # 1 or -1, from the first bit to the last
        # the document's own guess, as long as the bits so far agree with it: 1, -1 or 0
        sure = kinds[p : p + steps, :n].astype(np.int64)
        other = (guess[p : p + steps, :n] ^ now) + ((sure == RUNS) * 256)
        np.multiply(agree.take(other, axis=1), hits, out=t[:, many])
        sure += trusted
        map_hits = hits * np.float32(MAP_RATE)
        for step in range(steps):
            own_w = trust.take(sure[step])
            good.fill(1)
            for k in range(8):
                w, x, hit = weights[k], t[k, :, step], hits[k, step]
                w[many] = own_w
                np.einsum("kn,kn->n", w, x, out=z)
                np.minimum(np.maximum(z, -top, out=z), top, out=z)
                np.rint(z, out=place)
                np.add(place, here, out=where, casting="unsafe")
                np.multiply(z, quarter, out=z)
                np.tanh(z, out=prob)
                mapped = maps.take(where)
                # four times the probability of the bit that came
                np.add(prob, mapped, out=final)
                np.multiply(final, hit, out=final)
                np.add(final, two, out=final)
                np.multiply(good, final, out=good)
                np.multiply(mapped, keep_rate, out=mapped)
                np.add(mapped, map_hits[k, step], out=mapped)
                maps[where] = mapped
                # along the error, which is half of this
                np.subtract(hit, prob, out=prob)
                np.multiply(prob, rate, out=prob)
                np.multiply(x, prob, out=x)
                np.add(w, x, out=w)
                own_w = w[many]
            trust[sure[step]] = own_w
            cost[:n] += 16 - np.log2(np.maximum(good, 65536e-30, out=good))
        p += steps
    return cost


def text_bits(texts: list[bytes], halves: list[int], tables: np.ndarray, bits: int) -> np.ndarray:
    """The cost in bits of each text, given the half of the corpus that it is in."""
    out, halves = np.zeros(len(texts)), np.asarray(halves, np.int64)
    order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: -len(texts[k]))
    at = 0
    while at < len(order):
        most = max(1, min(LANES, GROUP_BYTES // len(texts[order[at]])))
        left = len(order) - at
        some = order[at : at + math.ceil(left / math.ceil(left / most))]  # no group of few lanes is left over
        out[some] = code_texts([texts[k] for k in some], halves[some], tables, bits)
        at += len(some)
    return out


def _by_length(docs: DataFrame, sizes: dict[int, int], kind) -> DataFrame:
    """The rows in partitions of like length (`kind`, of `sizes` bytes in all), the longest first: a lane step costs the same for few lanes as for many."""
    place, count = F.lit(0), 0
    for c in sorted(sizes, reverse=True):
        many = max(1, math.ceil(sizes[c] / min(GROUP_BYTES * 2 // 3, max(BUCKET_BYTES, 1024 << c))))
        place = F.when(kind == c, F.lit(count) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).cast("int")).otherwise(place)
        count += many
    return docs.repartitionById(max(count, 1), place.cast("int"))


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, total_bits, bits_per_byte) of each row; the last two rounded to 4 decimals.

    A null or empty text has 0 bytes, 0 bits and a null rate. Texts are read whole, whatever their length. Repeated rows count
    in the statistics as often as they occur, but never in those that score rows of their own id, and each gets its row. doc_id is of any type, null too; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    kind = F.greatest(F.lit(SHORT_CLASS), F.ceil(F.log2(F.greatest(size, F.lit(1))))).cast("int")
    sizes = {r[0]: r[1] for r in docs.groupBy(kind.alias("kind")).agg(F.sum(size)).collect()}  # a row for each power of two
    bits = slot_bits(sum(sizes.values()))
    path = table_file(docs, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = mapped(path, bits)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            cost = text_bits(texts, batch.column(2).to_pylist(), tables, bits)
            size = np.array([len(t) for t in texts], np.int64)
            rate = [round(float(c) / int(s), 4) if s else None for c, s in zip(cost, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(np.round(cost, 4)), pa.array(rate, pa.float64())],
                ["doc_id", "n_bytes", "total_bits", "bits_per_byte"],
            )

    rows = docs.select("doc_id", "text", half_of(docs).alias("half"))
    return _by_length(rows, sizes, kind).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, n_bytes bigint, total_bits double, bits_per_byte double")
