"""Consistent hashing with virtual nodes and bounded loads.

The ring has 2**grid_bits positions. A row's position is the top bits of the hash of its key; each
shard has `virtual_nodes` positions from the hash of its number. Positions are filled clockwise
from 0: the rows of a position go to the owner of the first virtual node at or after it, or, if they
would take that shard over its bound, on clockwise to the first shard with room for them.

One pass counts rows by position (partial sums on the map side, at most 2**grid_bits groups
whatever the input's size), the driver walks the ring over the counts, and the assignment is a
broadcast join with the ring, whose size is fixed by grid_bits. No row is shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SHARDS, VIRTUAL_NODES, SLACK, GRID_BITS, MOST_BITS = 64, 128, 0.05, 18, 20


def ring(shards: int, virtual_nodes: int, grid_bits: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    return sorted(
        (xxhash.xxh64_intdigest(f"shard-{s}-{v}", seed=7) >> (64 - grid_bits), s)
        for s in range(shards)
        for v in range(virtual_nodes)
    )


def bound(total: int, shards: int, slack: float) -> int:
    """The most rows a shard takes: (1 + slack) times the mean, rounded up."""
    return math.ceil((1 + slack) * total / shards)


def place(loads: dict[int, int], shards: int, virtual_nodes: int, slack: float, grid_bits: int) -> dict[int, int]:
    """The shard of each position of `loads` (position -> rows)."""
    nodes = ring(shards, virtual_nodes, grid_bits)
    at = [p for p, _ in nodes]
    most = bound(sum(loads.values()), shards, slack)
    room = [most] * shards
    out = {}
    for cell in sorted(loads):
        need, k = loads[cell], bisect_left(at, cell)
        for step in range(len(nodes)):
            shard = nodes[(k + step) % len(nodes)][1]
            if room[shard] >= need:
                break
        else:
            shard = int(np.argmax(room))  # one key repeated past every bound: it can't be split
        room[shard] -= need
        out[cell] = shard
    return out


def consistent_shards(
    docs: DataFrame,
    key: str = "doc_id",
    shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = SLACK,
    grid_bits: int = GRID_BITS,
) -> DataFrame:
    """`docs` with the column `shard` (INT, 0 to shards - 1), which replaces a column of that name.

    Every row gets a shard; no shard has more than ceil((1 + slack) * rows / shards) rows. Equal keys,
    repeated rows and null keys (one key) share a position and so a shard; only if the repeats of one
    position exceed every shard's room does its shard, the emptiest, exceed the bound. Text isn't read:
    null, empty and very long texts make no difference. An empty table gives an empty table. The key is of any type that can be hashed; other
    columns go along, whatever their names. `grid_bits` is at most MOST_BITS, as the ring's positions are held by the driver and broadcast.
    """
    if not 1 <= grid_bits <= MOST_BITS:
        raise ValueError(f"grid_bits must be from 1 to {MOST_BITS} (got {grid_bits})")
    cell = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 64 - grid_bits).cast("int")
    counts = docs.select(cell.alias("c")).groupBy("c").count().collect()
    placed = place({r["c"]: r["count"] for r in counts}, shards, virtual_nodes, slack, grid_bits)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != "shard"]
    at, own = fresh(docs, "cell", "shard")
    where = spark.createDataFrame([(int(c), int(s)) for c, s in placed.items()], f"{at} int, {own} int")
    return (
        docs.select(*(F.col(f"`{c}`") for c in kept), cell.alias(at))
        .join(F.broadcast(where), at, "left")  # at most 2**grid_bits pairs of ints, 8 MB
        .select(*(F.col(f"`{c}`") for c in kept), F.col(own).alias("shard"))
    )
