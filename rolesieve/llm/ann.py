"""Nearest neighbours by a block matrix join.

Vectors are scaled to length 1, packed into blocks and quantised to bytes with one scale per vector; the length of
what quantisation drops is kept. Every block of queries meets every block of candidates in one tile: the product of
the byte matrices gives all cosines of the tile, each within a proven error, and only pairs that can be among the
nearest are computed again from the original vectors in double precision. Heaps merge the tiles of a task, a ranked
group merges the tasks. The result is exact.

A tile holds some megabytes, whatever the input; blocks are dealt by a hash, so equal vectors spread.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different length are not compared; a query is never its own neighbour, nor are rows that share its id; an id that is
repeated counts once, with its nearest vector; null ids take no part; ties go to the smaller id. Without queries or
candidates the result is empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import stage

BLOCK_BYTES = 1 << 20
#: Blocks of candidates that one tile takes on average.
TILE_BLOCKS = 4
#: Queries that one task packs.
QUERY_ROWS = 8192
BLOCK = "block string, n int, dims int, ids binary, exact binary, codes binary, scales binary, errors binary"


def pack(vectors: DataFrame) -> DataFrame:
    """(id, vector array<double>) to blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def blocks(dims: int) -> pa.RecordBatch:
            rows = held.pop(dims)
            ids = np.array([r[0] for r in rows], np.int64)
            exact = np.array([r[1] for r in rows])
            unit = exact / np.abs(exact).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            scales = np.abs(unit).max(axis=1) / 127
            codes = np.rint(unit / scales[:, None]).astype(np.int8)
            errors = np.sqrt(((unit - codes * scales[:, None]) ** 2).sum(axis=1)) + 1e-9
            name = hashlib.md5(ids.tobytes() + exact.tobytes()).hexdigest()
            values = [name, len(rows), dims, ids.tobytes(), exact.tobytes(), codes.tobytes(), scales.tobytes(), errors.tobytes()]
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for part in batches:
            for i, v in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                values = v.values
                if i is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) * len(x) * 8 >= BLOCK_BYTES:
                    yield blocks(len(x))
        for dims in list(held):
            yield blocks(dims)

    return vectors.mapInArrow(run, BLOCK)


class Side:
    """A block unpacked."""

    def __init__(self, row):
        n, dims = int(row.n), int(row.dims)
        self.dims = dims
        self.ids = np.frombuffer(row.ids, np.int64)
        self.exact = np.frombuffer(row.exact, np.float64).reshape(n, dims)
        self.codes = np.frombuffer(row.codes, np.int8).reshape(n, dims)
        self.scales = np.frombuffer(row.scales, np.float64)
        self.errors = np.frombuffer(row.errors, np.float64)
        top = np.abs(self.exact).max(axis=1)
        self.scaled = self.exact / top[:, None]
        self.norms = np.sqrt((self.scaled * self.scaled).sum(axis=1))


def byte_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of byte matrices: exact, since sums over 1,024 products of bytes fit a float's 24 bits."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        total += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return total


def merge_tile(queries: Side, base: Side, k: int, heaps: dict[int, dict[int, float]]) -> None:
    """Enter the pairs of a tile that can be among the k nearest into the queries' heaps."""
    near = byte_products(queries.codes, base.codes) * queries.scales[:, None] * base.scales[None, :]
    slack = queries.errors[:, None] + base.errors[None, :] + queries.errors[:, None] * base.errors[None, :]
    near[queries.ids[:, None] == base.ids[None, :]] = -np.inf
    for at, q in enumerate(queries.ids.tolist()):
        best = heaps.setdefault(q, {})
        low, high = near[at] - slack[at], near[at] + slack[at]
        # an id that is repeated may hold several of the largest lower bounds
        floor = -np.inf
        if len(best) >= k:
            floor = min(heapq.nlargest(k, best.values()))
        else:
            _, first = np.unique(base.ids, return_index=True)
            if len(first) == len(base.ids) and len(low) > k:
                floor = np.partition(low, -k)[-k]
        picked = np.flatnonzero((high >= floor) & (near[at] > -np.inf))
        if not len(picked):
            continue
        dots = (queries.scaled[at] * base.scaled[picked]).sum(axis=1)
        scores = dots / (queries.norms[at] * base.norms[picked])
        for i, score in zip(base.ids[picked].tolist(), scores.tolist(), strict=True):
            if score > best.get(i, -math.inf):
                best[i] = score
        if len(best) > k:
            for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[k:]:
                del best[i]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` to each row of ``queries``."""
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    base = stage(pack(vectors.select(*columns)), "vector-blocks")
    asked = queries.repartition(max(1, math.ceil(queries.count() / QUERY_ROWS)))
    asked = stage(pack(asked.select(*columns)), "query-blocks")
    groups = max(1, asked.count())
    strips = max(1, math.ceil(base.count() / TILE_BLOCKS))
    strip, group = F.pmod(F.xxhash64("block"), F.lit(strips)), F.pmod(F.xxhash64("block"), F.lit(groups))
    every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    every_strip = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long")))
    left = asked.select("*", group.alias("g"), every_strip.alias("s"))
    right = base.select("*", strip.alias("s"), every_group.alias("g"))

    def tile(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[int, dict[int, float]] = {}
        for q in map(Side, some.itertuples()):
            for b in map(Side, others.itertuples()):
                if q.dims == b.dims:
                    merge_tile(q, b, k, heaps)
        rows = [(q, i, s) for q, best in heaps.items() for i, s in best.items()]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInPandas(tile, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
