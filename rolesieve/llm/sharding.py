"""Sharding along a Hilbert curve over document metadata.

Three dimensions (id, text size, source) are quantised to a few bits each, every row gets the index of its cell on
the Hilbert curve, and the order by that index is cut into runs whose row counts differ by one at most. Rows near in
all dimensions share a shard, so the minima and maxima of its files prune scans on any of them.

The cells (2^15 at most) are counted, large cells are split by a hash into parts of some 100,000 rows, and a row's
place is the start of its part plus its rank there. Whole rows move once, dealt by ranges of parts, and each task
writes the shards its range covers.

Edge cases: null ids and null sources take the first step of their dimension, a null text has no bytes. Rows are
never looked up by id, so repeated and null ids are written like any others. Rows that repeat id and text are
interchangeable. An empty table gives no rows. ``docs`` is read several times and must be the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import free_name, new_folder, stage

DIMENSIONS = 3
BITS = 5
PART_ROWS = 100_000


def _rotate(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def curve_table(n: int = DIMENSIONS) -> list[int]:
    """The curve as a machine: for state (entry corner, direction) and the next bit of each coordinate, the next digit
    of the index and the next state, packed as digit * states + state."""
    ungray = {_gray(i): i for i in range(1 << n)}

    def trailing_ones(i: int) -> int:
        return 0 if i % 2 == 0 else 1 + trailing_ones(i >> 1)

    table = []
    for entry in range(1 << n):
        for direction in range(n):
            for bits in range(1 << n):
                turned = _rotate(bits ^ entry, n - (direction + 1) % n, n)
                digit = ungray[turned]
                corner = 0 if digit == 0 else _gray(2 * ((digit - 1) // 2))
                turn = 0 if digit == 0 else trailing_ones(digit if digit % 2 else digit - 1) % n
                state = (entry ^ _rotate(corner, direction + 1, n)) * n + (direction + turn + 1) % n
                table.append(digit * (n << n) + state)
    return table


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """The index on the curve of the cell (x, y, z), each below 2^bits."""
    states = DIMENSIONS << DIMENSIONS
    machine = F.split(F.lit(",".join(map(str, curve_table()))), ",").cast("array<int>")

    def step(acc: Column, level: Column) -> Column:
        def bit(c: Column, at: int) -> Column:
            return F.call_function("shiftleft", F.call_function("shiftright", c, level).bitwiseAND(1), F.lit(at))

        found = F.get(machine, acc["state"] * (1 << DIMENSIONS) + bit(x, 2) + bit(y, 1) + bit(z, 0))
        index = acc["index"] * (1 << DIMENSIONS) + F.floor(found / states)
        return F.struct(index.cast("long").alias("index"), F.pmod(found, F.lit(states)).alias("state"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(levels, start, step)["index"]


def _steps(value: Column, low: float, high: float, bits: int) -> Column:
    """``value`` between low and high as a step from 0 to 2^bits - 1; null as 0."""
    width = (high - low) or 1
    raw = F.floor((value - F.lit(low)) * F.lit((1 << bits) / width))
    return F.coalesce(F.greatest(F.lit(0), F.least(raw, F.lit((1 << bits) - 1))), F.lit(0)).cast("int")


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long")


def _crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def curve_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, text_crc32, spread, cell and the whole ``row`` of every row."""
    ends = docs.agg(F.min(id_col), F.max(id_col)).first()
    sources = docs.select(F.col(source_col).alias("source")).distinct()
    order = Window.orderBy(F.col("source").asc_nulls_first())
    ranked = sources.select(
        F.col("source").alias("named"),
        F.row_number().over(order).alias("rank"),
        F.count("*").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("n"),
    )
    ranked = ranked.select("named", F.floor((F.col("rank") - 1) * (1 << BITS) / F.col("n")).cast("int").alias("z"))
    # the first source of each step, 2^BITS rows at most
    firsts = ranked.groupBy("z").agg(F.min("named").alias("first")).filter("first IS NOT NULL").collect()
    source, text = F.col(source_col), F.col(text_col)
    z = F.greatest(F.lit(0), F.lit(0), *[F.when(source >= F.lit(r["first"]), F.lit(r["z"])) for r in firsts])
    x = _steps(F.col(id_col), float(ends[0] or 0), float(ends[1] or 0) + 1, BITS)
    y = _steps(F.log2(_size(text)), 3.0, 27.0, BITS)
    rows = docs.select(
        F.col(id_col).alias("id"),
        _crc32(text).alias("text_crc32"),
        F.xxhash64(F.col(id_col), F.coalesce(text, F.lit(""))).alias("spread"),
        F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("at"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return rows.select("id", "text_crc32", "spread", hilbert_index(F.col("at.x"), F.col("at.y"), F.col("at.z")).alias("cell"), "row")


def global_place(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``place``, 0 to n - 1 in the order of (cell, part, spread, id), dealt by ranges of it; and n."""
    narrow = stage(rows.select("cell", "spread"), "curve-cells")
    cells = narrow.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    # at most 2^15 rows
    cells = stage(cells, "curve-parts")

    def parted(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(cells), "cell").withColumn("part", F.pmod("spread", F.col("parts"))).drop("parts")

    counts = parted(narrow).groupBy("cell", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("region", F.floor(F.col("cell") / 256))
    within = Window.partitionBy("region").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # one row for each 256 cells
    regions = counts.groupBy("region").agg(F.sum("n").alias("all"))
    before = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    regions = regions.select("region", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    starts = starts.join(F.broadcast(regions), "region").select(
        "cell", "part", (F.col("start") + F.col("offset")).alias("start")
    )
    starts = stage(starts, "curve-starts")
    # at most a row for each cell and one for each PART_ROWS rows
    dealt = parted(rows).join(F.broadcast(starts), ["cell", "part"]).repartitionByRange("cell", "part")
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("spread", "id", "text_crc32"))
    return dealt.withColumn("place", F.col("start") + rank - 1), narrow.count()


def own_names(docs: DataFrame) -> list[str]:
    """The names of slot, cell and shard in the table that is written."""
    return [free_name(docs.columns, name) for name in ("_slot", "_cell", "shard")]


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source") -> DataFrame:
    """``docs`` as one folder of Parquet per shard, each file in curve order; returns the table that was written: the
    columns of ``docs``, _slot (the place in the shard), _cell and shard, with further underscores where ``docs`` has
    columns of these names."""
    in_slot, in_cell, in_shard = own_names(docs)
    placed, total = global_place(curve_rows(docs, id_col, text_col, source_col))
    base, longer = divmod(total, shards)
    edge = longer * (base + 1)
    place = F.col("place")
    shard = F.when(place < edge, F.floor(place / (base + 1)))
    slot = F.when(place < edge, place % (base + 1))
    if base:
        shard = shard.otherwise(longer + F.floor((place - edge) / base))
        slot = slot.otherwise((place - edge) % base)
    laid = placed.select("row.*", slot.cast("long").alias(in_slot), F.col("cell").alias(in_cell), shard.cast("int").alias(in_shard))
    laid.sortWithinPartitions(in_shard, in_slot).write.partitionBy(in_shard).parquet(path)
    return docs.sparkSession.read.schema(laid.schema).parquet(path)


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """Writes the shards and gives one row per row in them: id, size, text_crc32, law, shard, slot, grown_shard, cell."""
    written = write_shards(docs, new_folder(docs.sparkSession, "hilbert-shards"), shards, id_col, text_col, source_col)
    in_slot, in_cell, in_shard = own_names(docs)
    return written.select(
        F.col(f"`{id_col}`"),
        _size(F.col(text_col)).alias("size"),
        _crc32(F.col(text_col)).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(in_shard).alias("shard"),
        F.col(in_slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col(in_cell).alias("cell"),
    )
