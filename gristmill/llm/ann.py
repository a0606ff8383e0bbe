"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are hashed to shards of about SHARD rows. In each shard a graph is built by insertion: a row's level is
drawn from its hashed id; from the entry at the top, beam searches lead down the layers, and in each layer from the row's level
down it is linked to neighbours that are nearer to it than to one another. A graph is flat arrays: per layer the
rows and a matrix of neighbours, -1 where there is none. Insertions and searches go through in batches, all
queries of a batch a step at a time by array operations.

Vectors are centred on their common mean before anything else, so that products of 32-bit numbers don't lose the differences. A graph's candidate
neighbours are found by blocked matrix products over the rows inserted before while these are at most EXACT, by beam search beyond. The beam's best are ranked again by
differences in 64 bits.

Every query asks every shard: a task holds the graph of one shard and streams blocks of queries past it; the shards' nearest are merged by
distance. Embeddings of this kind have no clusters by which a query could be sent to few shards (README). Distances are Euclidean, squared; equal ones go by id.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kind_of, written
from .kernels import U64, mix

K, SHARD, BLOCK, BLOCKS = 10, 16_384, 4096, 64
LINKS, BEAM_BUILD, BEAM_SEARCH, EXPAND, EXACT = 16, 64, 160, 4, 32_768


def _distances(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of q (b, d) to vectors[ids] (b, c); infinite where an id is -1."""
    dot = np.matmul(vectors[ids], q[:, :, None])[:, :, 0]
    out = (q * q).sum(1)[:, None] + norms[ids] - 2 * dot
    out[ids < 0] = np.inf
    return np.maximum(out, 0)


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry
        self.norms = (vectors * vectors).sum(1)

    def neighbours(self, layer: int, ids: np.ndarray) -> np.ndarray:
        where, links = self.layers[layer]
        out = links[where[ids]]
        out[ids < 0] = -1
        return out

    def beam(self, q: np.ndarray, ids: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the `width` best that a beam search from `ids` (b, c) finds, nearest first."""
        b = len(q)
        beam_i = np.full((b, width), -1, np.int64)
        beam_d = np.full((b, width), np.inf, np.float32)
        c = min(ids.shape[1], width)
        beam_i[:, :c] = ids[:, :c]
        beam_d[:, :c] = _distances(self.vectors, self.norms, q, ids[:, :c])
        done = beam_i < 0
        live = np.arange(b)
        while len(live):
            d, i, seen = beam_d[live], beam_i[live], done[live]
            # the nearest that aren't expanded yet
            pick = np.argsort(np.where(seen, np.inf, d), axis=1, kind="stable")[:, :EXPAND]
            open_ = ~np.take_along_axis(seen, pick, 1)
            chosen = np.where(open_, np.take_along_axis(i, pick, 1), -1)
            go = open_.any(1)
            live, d, i, seen, pick, chosen = live[go], d[go], i[go], seen[go], pick[go], chosen[go]
            if not len(live):
                break
            np.put_along_axis(seen, pick, True, 1)
            new = self.neighbours(layer, chosen.reshape(-1)).reshape(len(live), -1)
            # each once, and not those in the beam
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            inside = np.sort(i, axis=1)
            span = np.int64(len(self.vectors) + 2)
            offset = (np.arange(len(live)) * span)[:, None]
            at = np.searchsorted((inside + 1 + offset).reshape(-1), (new + 1 + offset).reshape(-1))
            at = np.minimum(at, inside.size - 1)
            new[((inside + 1 + offset).reshape(-1)[at] == (new + 1 + offset).reshape(-1)).reshape(new.shape)] = -1
            dist = _distances(self.vectors, self.norms, q[live], new).astype(np.float32)
            all_i, all_d = np.concatenate([i, new], 1), np.concatenate([d, dist], 1)
            all_s = np.concatenate([seen, new < 0], 1)
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            beam_i[live] = np.take_along_axis(all_i, best, 1)
            beam_d[live] = np.take_along_axis(all_d, best, 1)
            done[live] = np.take_along_axis(all_s, best, 1)
        beam_i[np.isinf(beam_d)] = -1
        order = np.lexsort((beam_i, beam_d), axis=1)
        return np.take_along_axis(beam_i, order, 1), np.take_along_axis(beam_d, order, 1)

    def search(self, q: np.ndarray, k: int, width: int = BEAM_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            ids = self.beam(q, ids, layer, 8)[0]
        i = self.beam(q, ids, 0, max(width, 2 * k))[0][:, : 2 * k]
        d = ((q[:, None, :].astype(np.float64) - self.vectors[i]) ** 2).sum(2)
        d[i < 0] = np.inf
        order = np.lexsort((i, d), axis=1)[:, :k]
        return np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        parts = {"vectors": self.vectors, "entry": np.array(self.entry)}
        for k, (where, links) in enumerate(self.layers):
            parts[f"where{k}"], parts[f"links{k}"] = where, links
        np.savez(out, **parts)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        n = sum(x.startswith("links") for x in z.files)
        return Graph(z["vectors"], [(z[f"where{k}"], z[f"links{k}"]) for k in range(n)], int(z["entry"]))


def diverse(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (b, c), nearest first, at most `most` that are nearer to the row than to one chosen; then the nearest others."""
    b, c = ids.shape
    v = vectors[ids]
    norms = (v * v).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((b, c), bool)
    number = np.zeros(b, np.int64)
    real = ids >= 0
    for j in range(c):
        near = (chosen & (between[:, j, :] <= dist[:, j : j + 1])).any(1)
        take = real[:, j] & ~near & (number < most)
        chosen[:, j] = take
        number += take
    rank = np.where(chosen, 0, np.where(real, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def build(keys: np.ndarray, vectors: np.ndarray, links: int = LINKS) -> Graph:
    """The graph of vectors (n, d); `keys` are hashed ids, which draw the levels and the order."""
    n = len(vectors)
    u = (mix(keys + U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) / 2.0**53
    levels = np.minimum((-np.log(np.maximum(u, 1e-300)) / math.log(links)).astype(np.int64), 12)
    order = np.lexsort((np.arange(n), mix(keys ^ U64(0xD6E8FEB86659FD93)), levels < levels.max()))
    top = int(levels.max())
    layers = []
    for layer in range(top + 1):
        members = np.flatnonzero(levels >= layer)
        where = np.full(n, -1, np.int32)
        where[members] = np.arange(len(members))
        layers.append((where, np.full((len(members), links * (2 if layer == 0 else 1)), -1, np.int32)))
    graph = Graph(np.ascontiguousarray(vectors, np.float32), layers, int(order[0]))
    inserted = [order[levels[order] >= layer] for layer in range(top + 1)]  # of each layer, in the order of insertion
    places = [np.flatnonzero(levels[order] >= layer) for layer in range(top + 1)]
    moved = [graph.vectors[x] for x in inserted]
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        ids = np.full((len(batch), 1), graph.entry, np.int64)
        for layer in range(top, -1, -1):
            mine = np.flatnonzero(levels[batch] >= layer)
            before = int(np.searchsorted(places[layer], at))
            if at <= EXACT:
                for k in range(0, len(mine), 256):
                    rows = batch[mine[k : k + 256]]
                    d = graph.norms[inserted[layer][:before]] - 2 * (graph.vectors[rows] @ moved[layer][:before].T)
                    rank = np.argpartition(d, BEAM_BUILD, axis=1)[:, :BEAM_BUILD] if before > BEAM_BUILD else np.broadcast_to(np.arange(before), d.shape)
                    d = np.maximum(np.take_along_axis(d, rank, 1) + graph.norms[rows][:, None], 0)
                    sort = np.argsort(d, axis=1, kind="stable")
                    _link(graph, layer, rows, inserted[layer][np.take_along_axis(rank, sort, 1)], np.take_along_axis(d, sort, 1), links)
                continue
            ids, dist = graph.beam(graph.vectors[batch], ids, layer, BEAM_BUILD if len(mine) else 8)
            if len(mine):
                _link(graph, layer, batch[mine], ids[mine], dist[mine], links)
        at += len(batch)
        size = min(max(1, at // 4), 1024)
    return graph


def _link(graph: Graph, layer: int, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, links: int) -> None:
    where, table = graph.layers[layer]
    most = table.shape[1]
    to = diverse(graph.vectors, ids, dist, links)
    table[where[rows], : to.shape[1]] = to
    # back, and where a row has too many, the diverse ones of all
    source, target = np.repeat(rows, to.shape[1]), to.reshape(-1)
    real = target >= 0
    source, target = source[real], target[real]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    heads, first, count = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(heads), 1024):
        h, f, c = heads[a : a + 1024], first[a : a + 1024], count[a : a + 1024]
        wide = int(c.max())
        come = f[:, None] + np.arange(wide)
        fresh = np.where(np.arange(wide) < c[:, None], source[np.minimum(come, len(source) - 1)], -1)
        both = np.concatenate([table[where[h]].astype(np.int64), fresh], 1)
        d = _distances(graph.vectors, graph.norms, graph.vectors[h], both)
        rank = np.argsort(d, axis=1, kind="stable")
        both, d = np.take_along_axis(both, rank, 1), np.take_along_axis(d, rank, 1)
        full = (both >= 0).sum(1) > most
        out = both[:, :most].copy()
        if full.any():
            keep = both.shape[1] if both.shape[1] <= 3 * most else 3 * most
            out[full] = diverse(graph.vectors, both[full, :keep], d[full, :keep], most)
        table[where[h]] = out


def _valid(dim: int):
    e = F.col("embedding")
    return e.isNotNull() & (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18))


def _built(centre: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = (np.stack(table.column("embedding").to_numpy()).astype(np.float64) - centre).astype(np.float32)[order]
        graph = build(ids[order].astype(np.int64).view(U64), vectors)
        return pa.table(
            {"s": [table.column("s")[0].as_py()], "ids": [ids[order].astype(np.int64).tobytes()], "data": [graph.dumps()]},
            pa.schema([("s", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]),
        )

    return run


def _packed(centre: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        vectors = (np.stack(table.column("embedding").to_numpy()).astype(np.float64) - centre).astype(np.float32)
        return pa.table(
            {"b": [table.column("b")[0].as_py()], "ids": [table.column("id").to_numpy().astype(np.int64).tobytes()], "data": [vectors.tobytes()]},
            pa.schema([("b", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]),
        )

    return run


def _searched(k: int):
    """For mapInArrow over partitions sorted by (s, g, b): a graph (b is -1), then the blocks of queries that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = names = None
        for batch in batches:
            for row in range(len(batch)):
                b, ids, data = (batch.column(c)[row].as_py() for c in (2, 3, 4))
                ids = np.frombuffer(ids, np.int64)
                if b < 0:
                    graph, names = Graph.loads(data), ids
                    continue
                q = np.frombuffer(data, np.float32).reshape(len(ids), -1)
                out = []
                for at in range(0, len(q), 512):
                    i, d = graph.search(q[at : at + 512], k + 1)
                    found = np.where(i >= 0, names[i], -1)
                    own = np.repeat(ids[at : at + 512], i.shape[1]).reshape(i.shape)
                    good = (i >= 0) & (found != own)
                    good &= np.cumsum(good, 1) <= k
                    out.append((own[good], found[good], d[good]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["vec_id", "neighbor_id", "distance"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if len(batch):
            part = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64).sum(0)
            total, n = part if total is None else total + part, n + len(batch)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["total", "n"])


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def nearest(vectors: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """(vec_id, neighbor_id, distance, rank) of the k nearest other rows of `vectors` of every query, rank from 1.

    `vectors` (vec_id, embedding, ...), `queries` alike, all rows of `vectors` if None; other columns are ignored, whatever their names. vec_id is a whole number or of any other type that can be
    ordered. The dimension is the commonest size of an array; rows of
    another, of null vec_id or embedding, or with a null, NaN or immense component are left out on both sides. Rows that repeat a
    vec_id count once, with the first vector by its components; a query isn't its own neighbour. Equal vectors are neighbours at distance 0. Of fewer than
    k + 1 rows all others are neighbours. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = kind_of(vectors, "vec_id")
    schema = f"vec_id {kind}, neighbor_id {kind}, distance double, rank int"
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count()
    dim = sizes.where("d > 0").orderBy(F.desc("count"), "d").first()
    if dim is None:
        return spark.createDataFrame([], schema)

    def once(df):
        e = F.col("embedding").cast("array<double>")
        return df.where(F.col("vec_id").isNotNull() & _valid(dim["d"])).groupBy("vec_id").agg(F.min(e).alias("embedding"))

    rows = once(vectors)
    number = F.col("vec_id").cast("bigint") if kind in _WHOLE else F.monotonically_increasing_id()
    rows = written(rows.withColumn("id", number))
    asked = rows if queries is None else once(queries)
    if queries is not None:
        # numbered as in `rows`; ids of the queries alone don't occur there, and have negative numbers
        alone = asked.join(rows.select("vec_id"), "vec_id", "left_anti")
        asked = asked.join(rows.select("vec_id", "id"), "vec_id") if kind not in _WHOLE else asked.withColumn("id", number)
        if kind not in _WHOLE:
            asked = asked.unionByName(alone.withColumn("id", -1 - F.monotonically_increasing_id()))
        asked = written(asked)
    sums = rows.select("embedding").mapInArrow(_summed, "total array<double>, n bigint").select(
        F.posexplode("total").alias("p", "x"), "n"
    ).groupBy("p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("p").collect()  # a row a dimension
    if not sums:
        return spark.createDataFrame([], schema)
    n, centre = sums[0]["n"], np.array([r["x"] / r["n"] for r in sums])
    blocks = max(1, math.ceil(asked.count() / block))
    shards, groups = max(1, math.ceil(n / shard)), max(1, math.ceil(blocks / BLOCKS))
    graphs = (
        rows.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"))
        .groupBy("s").applyInArrow(_built(centre), "s int, ids binary, data binary")
    )
    packed = (
        asked.select("id", "embedding", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(blocks)).cast("int").alias("b"))
        .groupBy("b").applyInArrow(_packed(centre), "b int, ids binary, data binary")
    )
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    tasks = graphs.select("s", every(groups).alias("g"), F.lit(-1).alias("b"), "ids", "data").unionByName(
        packed.select(every(shards).alias("s"), (F.col("b") % groups).alias("g"), "b", "ids", "data")
    )
    found = (
        tasks.repartition(shards * groups, "s", "g").sortWithinPartitions("s", "g", "b")
        .mapInArrow(_searched(k), "vec_id bigint, neighbor_id bigint, distance double")
    )
    if kind in _WHOLE:
        found = found.select(F.col("vec_id").cast(kind).alias("vec_id"), F.col("neighbor_id").cast(kind).alias("neighbor_id"), "distance")
    else:
        names = asked.select(F.col("id").alias("vec_id"), F.col("vec_id").alias("own")).join(found, "vec_id")
        found = names.join(rows.select(F.col("id").alias("neighbor_id"), F.col("vec_id").alias("other")), "neighbor_id").select(
            F.col("own").alias("vec_id"), F.col("other").alias("neighbor_id"), "distance"
        )
    best = W.partitionBy("vec_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
