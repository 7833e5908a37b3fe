"""Hard negatives by exact integer scores: matrix products in a residue number system, then a window per positive.

Components are scaled and rounded down to integers. A score, the inner product of two such vectors, is computed modulo
several small primes: residues near zero are multiplied as float32 matrices, exactly, since sums over 1,024 products of
such residues stay below 2^24, and the Chinese remainder theorem gives back the signed score. A tile takes as many
primes as the largest lengths of its vectors call for (three for vectors of length 1, eight at most).

Anchors and rows are packed into blocks in order of label, dealt to groups and strips by a hash; each group meets each
strip in one tile. The first pass looks for the positives of every anchor and skips pairs of blocks without a common
label; the second has the positives' scores and looks in each positive's window of scores among other labels. A task
keeps the first few per anchor or positive, a ranked group over all tiles picks the final ones. Blocks carry the
integers in the fewest bytes that hold them, nothing else of the vectors moves.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; rows count as often
as they occur, also if an id is repeated, and a row is only excluded from its own positives; null ids come last among
ties; vectors of different length are not compared; empty vectors score 0 with each other; anchors without a positive,
and positives without a negative in their window (always so if the positive's score is below zero), give no row; ties
go to the smaller id; an empty table gives no rows. Scores beyond 64 bits raise an OverflowError. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import stage

#: The eight largest primes below 2^8; their product stays below 2^63.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Products of residues that a float32 adds exactly.
DEPTH = 1024
BLOCK_ROWS = 2048
STRIP_ROWS = 65536
GROUP_ROWS = 8192
#: Anchors of a tile that are scored against a block at once.
SLICE = 512
#: Tasks of one join of tiles; beyond it a task takes several tiles, one after the other.
MOST_TASKS = 20_000
BLOCK = "block long, n int, dims int, uids binary, ids binary, named binary, labels binary, values binary, kind string"
FOUND = "g long, anchor long, anchor_id long, of long, uid long, id long, score long"
NONE = np.iinfo(np.int64).min


def pack(rows: DataFrame, scale: int) -> DataFrame:
    """(uid, id, label, vector array<double>) to blocks of integer vectors of one length."""

    def block(name: int, dims: int, held: list[tuple]) -> pa.RecordBatch:
        uids, ids, labels, vectors = zip(*held, strict=True)
        values = np.floor(scale * np.array(vectors).reshape(len(held), dims))
        if values.size and np.abs(values).max() >= 2.0**62:
            raise OverflowError("a component is too large for scores of 64 bits")
        values = values.astype(np.int64)
        kind = np.min_scalar_type(-int(np.abs(values).max(initial=0)) - 1).name
        made = [
            name, len(held), dims, np.array(uids, np.int64).tobytes(),
            np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(),
            np.array(labels, np.int64).tobytes(), values.astype(kind).tobytes(), kind,
        ]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for part in batches:
            uids, ids, labels = (part.column(i).to_pylist() for i in range(3))
            for uid, i, label, vector in zip(uids, ids, labels, part.column(3), strict=True):
                values = vector.values
                if values is None or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                same = held.setdefault(len(x), [])
                same.append((uid, i, label, x))
                if len(same) == BLOCK_ROWS:
                    yield block(uid, len(x), held.pop(len(x)))
        for dims, rest in held.items():
            yield block(rest[-1][0], dims, rest)

    return rows.mapInArrow(run, BLOCK)


class Side:
    """A block unpacked, its rows in order of id."""

    def __init__(self, row):
        n, dims = int(row.n), int(row.dims)
        uids, ids = np.frombuffer(row.uids, np.int64), np.frombuffer(row.ids, np.int64)
        named, labels = np.frombuffer(row.named, bool), np.frombuffer(row.labels, np.int64)
        order = np.lexsort((uids, ids, ~named))
        self.dims = dims
        self.uids, self.ids, self.named, self.labels = uids[order], ids[order], named[order], labels[order]
        self.values = np.frombuffer(row.values, row.kind).reshape(n, dims)[order].astype(np.int64)
        self.span = int(self.labels.min()), int(self.labels.max())
        self.length = math.sqrt((self.values.astype(np.float64) ** 2).sum(axis=1).max())
        self.made: dict[int, np.ndarray] = {}

    def residues(self, prime: int) -> np.ndarray:
        """The residues nearest to zero."""
        if prime not in self.made:
            half = prime // 2
            self.made[prime] = ((self.values + half) % prime - half).astype(np.float32)
        return self.made[prime]


def primes_for(bound: float) -> tuple[int, ...]:
    """The fewest primes whose residues tell all integers up to ``bound`` in size apart."""
    product = 1
    for at, prime in enumerate(PRIMES):
        product *= prime
        if product > 2.001 * bound + 2:
            return PRIMES[: at + 1]
    raise OverflowError("scores do not fit 64 bits")


def scores(a: Side, b: Side, rows: slice) -> np.ndarray:
    """The exact inner products of rows of ``a`` with ``b``."""
    primes = primes_for(a.length * b.length)
    value, product = None, 1
    for prime in primes:
        left, right = a.residues(prime)[rows], b.residues(prime)
        residue = np.zeros((len(left), len(right)), np.int64)
        for at in range(0, a.dims, DEPTH):
            residue += (left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T).astype(np.int64)
        if value is None:
            value = residue % prime
        else:
            # the digit in the mixed radix system of the primes so far
            residue -= value
            residue %= prime
            residue *= pow(product, -1, prime)
            residue %= prime
            residue *= product
            value += residue
        product *= prime
    value[value > product // 2] -= product
    return value


def first_of_label(a: Side, b: Side, k: int) -> Iterator[pd.DataFrame]:
    """The first k rows of ``b`` with the label of each row of ``a``, itself excepted."""
    if a.span[0] > b.span[1] or b.span[0] > a.span[1]:
        return
    for start in range(0, len(a.ids), SLICE):
        part = slice(start, start + SLICE)
        score = scores(a, b, part)
        score[(a.labels[part, None] != b.labels) | (a.uids[part, None] == b.uids)] = NONE
        at = np.arange(len(score))
        for _ in range(min(k, len(b.ids))):
            # the first of equal scores, that of the smaller id
            best = score.argmax(axis=1)
            top = score[at, best]
            some = np.flatnonzero(top > NONE)
            score[at, best] = NONE
            yield found(a, b, start + some, best[some], top[some], -1)


def in_windows(a: Side, b: Side, k: int, windows: dict[int, list[tuple[int, int, int]]]) -> Iterator[pd.DataFrame]:
    """Of rows of ``b`` with another label than a row of ``a``, the first k in each of its windows (of, low, high)."""
    if a.span == b.span and a.span[0] == a.span[1]:
        return
    low = np.array([min((w[1] for w in windows.get(u, ())), default=1) for u in a.uids.tolist()], np.int64)
    high = np.array([max((w[2] for w in windows.get(u, ())), default=0) for u in a.uids.tolist()], np.int64)
    for start in range(0, len(a.ids), SLICE):
        part = slice(start, start + SLICE)
        score = scores(a, b, part)
        fits = (score >= low[part, None]) & (score <= high[part, None]) & (a.labels[part, None] != b.labels)
        rows, columns = np.nonzero(fits)
        values = score[rows, columns]
        order = np.lexsort((columns, -values, rows))
        rows, columns, values = rows[order], columns[order], values[order]
        ends = np.searchsorted(rows, np.arange(len(score) + 1))
        taken, positives = [], []
        for at in np.unique(rows).tolist():
            begin, end = ends[at], ends[at + 1]
            falling = -values[begin:end]
            for of, least, most in windows[int(a.uids[start + at])]:
                first = begin + np.searchsorted(falling, -most)
                last = min(first + k, begin + np.searchsorted(falling, -least, side="right"))
                taken.append(np.arange(first, last))
                positives.append(np.full(len(taken[-1]), of))
        if taken:
            some = np.concatenate(taken)
            yield found(a, b, start + rows[some], columns[some], values[some], np.concatenate(positives))


def found(a: Side, b: Side, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, of: int | np.ndarray) -> pd.DataFrame:
    ids = pd.array(b.ids[columns], dtype="Int64")
    ids[~b.named[columns]] = pd.NA
    return pd.DataFrame({
        "anchor": a.uids[rows], "anchor_id": a.ids[rows], "of": of, "uid": b.uids[columns], "id": ids, "score": values,
    })


def first_rows(parts: list[pd.DataFrame], g: int, k: int) -> pd.DataFrame:
    """Of what the block pairs of a tile gave, the first k per anchor and positive."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    if not parts:
        return pd.DataFrame({c: pd.Series(dtype="Int64") for c in names})
    rows = pd.concat(parts).sort_values(["anchor", "of", "score", "id", "uid"], ascending=[True, True, False, True, True])
    return rows.groupby(["anchor", "of"]).head(k).assign(g=g)[names]


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with rank, the first k per anchor and positive over all tiles."""
    order = Window.partitionBy("anchor", "of").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tiles(asked: DataFrame, base: DataFrame, groups: int, strips: int, extra: DataFrame | None, tile) -> DataFrame:
    """``tile`` applied to each group of anchor blocks (and the rows of ``extra`` for it) with each strip of blocks."""
    every_strip = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)).cast("array<long>")).alias("s")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("g")
    left = asked.select("*", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"))
    if extra is not None:
        left = left.unionByName(extra, allowMissingColumns=True)
    # a task for each tile: tiles are work, however few bytes they are
    tasks = min(groups * strips, MOST_TASKS)
    left = left.select("*", every_strip).repartition(tasks, "g", "s")
    right = base.select("*", F.pmod(F.xxhash64("block"), F.lit(strips)).alias("s")).select("*", every_group)
    right = right.repartition(tasks, "g", "s")
    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInPandas(tile, FOUND)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row where ``anchor`` holds
    and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score
    is between ``low`` per cent of the positive's and the positive's."""
    spark = rows.sparkSession
    usable = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("asked"),
    )
    usable = stage(usable, "mining-rows")
    columns = ["uid", "id", "label", "vector"]

    def packed(some: DataFrame, kind: str) -> DataFrame:
        ordered = some.select(columns).repartitionByRange("label", "uid").sortWithinPartitions("label", "uid")
        return stage(pack(ordered, scale), kind)

    base, asked = packed(usable, "mining-blocks"), packed(usable.filter("asked"), "anchor-blocks")
    n, m = usable.count(), usable.filter("asked").count()
    parallel = 2 * spark.sparkContext.defaultParallelism
    strips = max(1, -(-n // STRIP_ROWS), min(parallel, -(-n // BLOCK_ROWS)))
    groups = max(1, -(-m // GROUP_ROWS))

    def pairs(some: pd.DataFrame, others: pd.DataFrame) -> Iterator[tuple[Side, Side]]:
        anchors = [Side(r) for r in some.itertuples()]
        for row in others.itertuples():
            b = Side(row)
            for a in anchors:
                if a.dims == b.dims:
                    yield a, b

    def positive_tile(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return first_rows([], 0, positives)
        parts: list[pd.DataFrame] = []
        for a, b in pairs(some, others):
            parts = [first_rows([*parts, *first_of_label(a, b, positives)], int(some["g"].iloc[0]), positives)]
        return first_rows(parts, int(some["g"].iloc[0]), positives)

    chosen = stage(ranked(tiles(asked, base, groups, strips, None, positive_tile), positives), "positives")

    def negative_tile(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return first_rows([], 0, negatives)
        told = some["block"].isna()
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for r in some[told].itertuples():
            high = int(r.high)
            least = -(-low * high // 100)
            if least <= high:
                windows.setdefault(int(r.anchor), []).append((int(r.of), least, high))
        parts: list[pd.DataFrame] = []
        for a, b in pairs(some[~told], others):
            parts = [first_rows([*parts, *in_windows(a, b, negatives, windows)], int(some["g"].iloc[0]), negatives)]
        return first_rows(parts, int(some["g"].iloc[0]), negatives)

    told = chosen.select("g", "anchor", F.col("uid").alias("of"), F.col("score").alias("high"))
    met = ranked(tiles(asked, base, groups, strips, told, negative_tile), negatives)
    of = chosen.select("anchor", F.col("uid").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return met.join(of, ["anchor", "of"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
