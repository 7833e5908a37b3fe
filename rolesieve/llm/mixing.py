"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of fixed length. Every slot of the mix falls
into one of the output shards at random, which makes the source counts of a shard a multinomial draw; a source's
slots are numbered through the shards, a pseudorandom permutation of its block numbers turns slot numbers into
blocks, and blocks and slots are joined by number. Slots beyond the number of blocks start the next pass, so no word
is taken more than once more often than any other of its source.

Targets: all sources share ``share`` of all words by weight; a target stops at ``most`` times its source's size, and
what is left over is shared again by weight.

Edge cases: a null text or one of separators only has size 0 and is never taken; null sources form a source of their
own, last in the order; a null id is an id; rows that repeat everything take interchangeable places. An empty table
gives no rows. Other columns are not read by the plan and are kept by ``mixed_documents``.

All joins are merge joins by hint. Spark sizes the rows of an explode by the few it is made from, and a staged table by
its packed files; by these it would broadcast slots, spans or places, which grow with the words, through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import WORD, stage, word_count

WEIGHTS = (3, 1, 2)
BUCKET_ROWS = 50_000
#: Slots made from one row.
RUN = 1 << 16
#: Slots made in one task.
TASK_SLOTS = 4 * RUN
ROUNDS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to source_no by code point (null last), weight and target. One row per source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * most)
    # sources reach their cap in this order, whatever the level is
    soonest = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, onward = soonest.rowsBetween(Window.unboundedPreceding, -1), soonest.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1)).orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = capped.withColumn("level", level)
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        F.col("cap") / F.col("weight"), "source_no", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(first_open, F.lit(math.inf)) * F.col("weight"))
    return levels.select("source", "source_no", "source_size", target.alias("target"))


def permuted(at: Column, n: Column, key: Column, seed: int, inverse: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..n-1 puts ``at``: rounds that swap x and k - x (mod n) or leave both."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, r), n) - x, n)
        swap = F.pmod(F.xxhash64(F.lit(seed + 1), key, r, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.reverse(rounds) if inverse else rounds, at.cast("long"), step)


def place_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...],
                    share: float, most: float) -> DataFrame:
    """id, text_hash, size, source_no, source_size, target and ``start``, the place of the first word in its source.

    Running sums are taken within buckets of some 50,000 rows, and over the sums of the buckets.
    """
    buckets = max(1, math.ceil(docs.count() / BUCKET_ROWS))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = stage(rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_hash"), F.lit(buckets))), "mix-sizes")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("s")
    starts = starts.join(targets.hint("merge").alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("named"), F.col("bucket").alias("in_bucket"), "offset", "source_no", "source_size", "target"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("named")) & (F.col("bucket") == F.col("in_bucket"))
    placed = running.join(starts.hint("merge"), same).withColumn("start", F.col("offset") + F.col("inside"))
    return placed.select("id", "text_hash", "source", "size", "source_no", "source_size", "target", "start")


def draw_slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(source_no, source_size, target) to the slots of the mix: shard, source_no, slot, pass, block and the words to
    take from the block (the last slot of a source may end inside its block)."""
    size, wanted, no = F.col("source_size"), F.col("wanted"), F.col("source_no")
    blocks = F.ceil(size / block_words).cast("long")
    plan = sources.filter("source_size > 0").withColumn("wanted", F.round("target").cast("long"))
    plan = plan.withColumns({"blocks": blocks, "passes": F.floor(wanted / size), "rest": wanted % size})
    plan = plan.withColumn("last_words", size - (F.col("blocks") - 1) * block_words)
    short_at = permuted(F.col("blocks") - 1, F.col("blocks"), no, seed, inverse=True)
    plan = plan.withColumn("short_at", short_at).withColumn("missing", block_words - F.col("last_words"))
    plain = F.ceil(F.col("rest") / block_words)
    # the short block lies among those of the last, partial pass when it stands before the slot that would end it
    partial = F.when(plain <= F.col("short_at"), plain).otherwise(
        F.greatest(F.col("short_at") + 1, F.ceil((F.col("rest") + F.col("missing")) / block_words))
    )
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.when(F.col("rest") > 0, partial).otherwise(0))
    plan = stage(plan, "mix-sources")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_slots))
    runs = plan.filter("slots > 0").select(
        "source_no", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))).alias("run")
    )
    tickets = runs.repartition("source_no", "run").select(
        "source_no",
        F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("slots")) - 1)).alias("ticket"),
    )
    drawn = tickets.groupBy("source_no", F.pmod(F.xxhash64(F.lit(seed + 2), "source_no", "ticket"), F.lit(shards))
                            .alias("shard")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = drawn.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # one source's shards are dealt over tasks, as each row becomes all its slots
    tasks = max(1, math.ceil(total / TASK_SLOTS))
    numbered = counted.join(plan.hint("merge"), "source_no").repartition(tasks, "source_no", "shard").select(
        "shard", "source_no", "blocks", "passes", "rest", "short_at", "missing", "last_words",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"),
    )
    numbered = numbered.withColumns({"pass": F.floor(F.col("slot") / F.col("blocks")), "at": F.col("slot") % F.col("blocks")})
    block = permuted(F.col("at"), F.col("blocks"), no, seed)
    cut = numbered.withColumn("block", block)
    full = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_words")).otherwise(block_words)
    gone = F.col("at") * block_words - F.when(F.col("short_at") < F.col("at"), F.col("missing")).otherwise(0)
    take = F.when(F.col("pass") < F.col("passes"), full).otherwise(F.least(full, F.col("rest") - gone))
    return cut.select("shard", "source_no", "slot", "pass", "block", take.cast("long").alias("take"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 128,
             shard_slots: int = 1024, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The placed documents, and the pieces of the mix: shard, slot, pass, source_no, start and size of the document,
    and the words ``first`` to ``last`` (exclusive) of the document that the slot takes."""
    placed = stage(place_documents(docs, id_col, text_col, source_col, weights, share, most), "mix-places")
    sources = placed.groupBy("source_no").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    slots = draw_slots(sources, block_words, shard_slots, seed)
    start, size, block = F.col("start"), F.col("size"), F.col("block")
    spans = placed.filter("size > 0").select("source_no", "start", "size", F.explode(F.sequence(
        F.floor(start / block_words), F.floor((start + size - 1) / block_words))).alias("block"))
    met = slots.hint("merge").join(spans, ["source_no", "block"])
    first = F.greatest(block * block_words, start)
    last = F.least(block * block_words + F.col("take"), start + size)
    pieces = met.select("shard", "slot", "pass", "source_no", "start", (first - start).alias("first"), (last - start).alias("last"))
    return placed, pieces.filter("last > first")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken."""
    placed, pieces = mix_plan(docs, id_col, **options)
    taken = pieces.groupBy("source_no", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    # places are unique among documents that have words
    with_words = placed.filter("size > 0").join(taken.hint("merge"), ["source_no", "start"], "left")
    columns = [F.col("id").alias(id_col), "size", "source_size", "target"]
    counts = with_words.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"))
    return counts.unionByName(placed.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as documents, with all columns of ``docs``: one row for each pass that takes words of a document.

    A pass that takes the whole text keeps it as it is; else the text is the words taken, in order, a blank between
    two. ``n_chars``, where there is such a column, follows the text.
    """
    placed, pieces = mix_plan(docs, id_col, text_col, **options)
    span = F.struct("first", "last")
    passes = pieces.groupBy("source_no", "start", "pass").agg(
        F.sort_array(F.collect_list(span)).alias("_spans"), F.sum(F.col("last") - F.col("first")).alias("_taken")
    )
    # rows that repeat id and text are told apart by a number, which pairs them with as many places
    copy = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("source_no", "start"))
    numbered = placed.filter("size > 0").withColumn("_copy", copy)
    uses = numbered.join(passes.hint("merge"), ["source_no", "start"]).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"), "_copy", F.col("size").alias("_size"), "_spans", "_taken"
    )
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    source_order = F.col(options.get("source_col", "source")).asc_nulls_last()
    nth = F.row_number().over(Window.partitionBy(id_col, "_hash").orderBy(source_order))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash")) & (F.col("_nth") == F.col("_copy"))
    met = hashed.withColumn("_nth", nth).join(uses.hint("merge"), same)
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    some = F.array_join(
        F.flatten(F.transform("_spans", lambda s: F.slice(words, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))),
        " ",
    )
    text = F.when(F.col("_taken") == F.col("_size"), F.col(text_col)).otherwise(some)
    mixed = met.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)
