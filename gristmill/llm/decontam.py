"""Benchmark decontamination: size-partitioned MinHash containment search.

A text's shingles are runs of `n` tokens of its lower-cased text. Documents are partitioned by their
number of shingles, to the next power of two; the documents of a partition have one-permutation
MinHash sketches of as many bins, so that a bin holds one shingle or so whatever the document's length
and a short item inside a long document still meets its minima: a shared shingle is the minimum of its bin
with a probability over 0.6, and an item with 8 shared shingles is missed once in 2000 documents. An item is a
candidate if one of its shingles is a minimum. Items that need fewer than EXACT shared shingles would be missed
more often: for these, all shingles of the documents are looked up. Candidates are verified by exact containment: the share of
the item's distinct shingles that the document has.

Items are sketch keys in an array that every task holds. They are read in blocks of at most `block` items and about SHINGLES shingles, which are broadcast; with more
than one, each is a pass over the documents, so no task holds more than one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, kind_of
from .kernels import U64, gram_sets, ngram_hashes, slices, token_hashes

N, THRESHOLD, BLOCK, SHINGLES, FILTER_BITS = 3, 0.6, 100_000, 4_000_000, 22
EXACT = 8


class _Keys:
    """The shingles of the items `numbers`, for finding which items have a value."""

    def __init__(self, sets: list[np.ndarray], numbers: list[int]):
        owner = np.repeat(np.array(numbers, np.int64), [len(sets[k]) for k in numbers])
        keys = np.concatenate([np.zeros(0, U64), *(sets[k] for k in numbers)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `values`, item) of each value that an item has."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = np.flatnonzero(self.maybe[(values >> U64(64 - FILTER_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.keys, values[hit], "left")
        many = np.searchsorted(self.keys, values[hit], "right") - lo
        item = self.owner[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        return np.repeat(hit, many), item


def _matches(shared, n: int, threshold: float):
    """The function for mapInArrow that finds the items of a broadcast (ids, sets) in a batch of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, sets = shared.value
        few = [math.ceil(threshold * len(s)) < EXACT for s in sets]
        long = _Keys(sets, [k for k, x in enumerate(few) if not x])
        short = _Keys(sets, [k for k, x in enumerate(few) if x])
        for batch in batches:
            docs, found, shares = [], [], []
            for i, j, buf, offs in slices(batch.column(1)):
                grams, at = ngram_hashes(*token_hashes(buf, offs), n)
                count = np.diff(at)
                # bins: the next power of two of the shingles' number
                bits = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
                base = np.concatenate([[0], np.cumsum(np.int64(1) << bits)])
                shift = np.repeat((64 - bits).astype(U64), count)
                # a shift by 64 is undefined: one bin then
                place = np.where(shift == 64, U64(0), grams >> np.minimum(shift, U64(63))).astype(np.int64)
                minima = np.full(base[-1], np.iinfo(np.uint64).max, U64)
                np.minimum.at(minima, np.repeat(base[:-1], count) + place, grams)
                place, item = long.find(minima)
                doc = np.searchsorted(base, place, "right") - 1
                place, other = short.find(grams)
                doc = np.concatenate([doc, np.searchsorted(at, place, "right") - 1])
                pairs = np.unique(doc * len(sets) + np.concatenate([item, other]))
                last, have = -1, None
                for d, k in zip(pairs // max(len(sets), 1), pairs % max(len(sets), 1)):
                    if d != last:
                        last, have = d, grams[at[d] : at[d + 1]]
                    share = float(np.isin(sets[k], have).sum()) / len(sets[k])
                    if share >= threshold:
                        docs.append(i + int(d))
                        found.append(int(k))
                        shares.append(share)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs, pa.int64())), items.take(pa.array(found, pa.int64())), pa.array(shares, pa.float64())],
                ["doc_id", "item_id", "containment"],
            )

    return run


def _item_blocks(items: DataFrame, n: int, block: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets) of the items with shingles, in blocks; one empty block if there are none."""
    kind = items.schema["item_id"].dataType
    ids, sets, size, number = [], [], 0, 0

    def made():
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array(ids, to_arrow_type(kind)), list(sets)

    for row in items.select("item_id", F.lower("text")).toLocalIterator():
        for _, s in gram_sets(pa.array([row[1]], pa.large_string()), n):
            if len(s):
                ids.append(row[0])
                sets.append(s)
                size += len(s)
        if len(ids) == block or size >= SHINGLES:
            yield made()
            ids, sets, size, number = [], [], 0, number + 1
    if ids or not number:
        yield made()


def contaminated(
    docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(doc_id, item_id, containment) of all documents that hold at least `threshold` of an item's shingles.

    `docs` (doc_id, text, ...) and `items` (item_id, text, ...); ids of any type; other columns are ignored, whatever their names. Null and empty
    texts have no shingles and match nothing; a text of fewer than n tokens has one shingle, all of it. Texts
    are read whole. Repeated documents and repeated items each give their own rows, those of null ids too. Empty tables give no rows.
    """
    texts = docs.select("doc_id", F.lower("text").alias("text"))
    schema = f"doc_id {kind_of(docs, 'doc_id')}, item_id {kind_of(items, 'item_id')}, containment double"
    out = None
    for made in _item_blocks(items, n, block):
        shared = docs.sparkSession.sparkContext.broadcast(made)  # at most `block` items and about SHINGLES shingles of 8 bytes
        found = texts.mapInArrow(_matches(shared, n, threshold), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that hold an item; same columns, of whatever names.

    Null and empty texts stay, as do rows of null doc_id; rows that repeat a doc_id go if one of them holds an item. An empty
    table gives an empty table, an empty table of items all documents.
    """
    (bad,) = fresh(docs, "bad")
    ids = contaminated(docs, items, n, threshold).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(ids, docs["doc_id"] == ids[bad], "left_anti")


_GRAMS = f"""
  SELECT {{id}}, CASE WHEN len(w) >= {N} THEN list_distinct(list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i : i + {N - 1}], ' ')))
    ELSE [array_to_string(w, ' ')] END AS grams
  FROM (SELECT {{id}}, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM {{table}}) WHERE len(w) > 0
"""

ORACLE = f"""
WITH d AS ({_GRAMS.format(id="doc_id", table="documents")}),
i AS ({_GRAMS.format(id="item_id", table="benchmark")}),
dg AS (SELECT doc_id, unnest(grams) AS g FROM d),
ig AS (SELECT item_id, len(grams) AS size, unnest(grams) AS g FROM i)
SELECT doc_id, item_id, count(*) / CAST(any_value(size) AS DOUBLE) AS containment
FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id HAVING count(*) / CAST(any_value(size) AS DOUBLE) >= {THRESHOLD}
"""
