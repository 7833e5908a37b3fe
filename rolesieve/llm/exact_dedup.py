"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so, the distinct chunks get verified identifiers, and two texts are equal
when their ordered lists of identifiers are. Chunk bodies move once, and only one of each kind per task; what is
compared afterwards is a list of numbers per document.

Edge cases: a null text counts as empty, and empty texts are equal to each other. Of equal texts the row with the
smallest id stays; a null id loses against any other. Rows that repeat id and text are one document: they get the same
decision, and ``drop_copies`` keeps one of them. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import normalised, stage

#: Code points that may stand before a cut: a quarter of them, spread by a multiplicative hash.
CUT_CLASS = "".join(rf"\x{{{c:x}}}" for c in range(0x21, 0x250) if (c * 2654435761 >> 16) % 4 == 0)


def chunks(text: Column, least: int = 30, most: int = 150) -> Column:
    """The text cut after a word whose last two characters are of the cut class, once ``least`` words are reached and
    after ``most`` at the latest; where words of over 64 characters are in the way, after 1,000 characters. The same
    content gives the same cuts. An empty text has no chunks."""
    pattern = rf"(?s)(?:[^ ]{{0,64}}+ ){{{least},{most}}}?(?<=[{CUT_CLASS}]{{2}} )|.{{1,1000}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fingerprint(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def chunk_identifiers(bodies: DataFrame) -> DataFrame:
    """(fingerprint, chunk) of every occurrence to the distinct chunks whose fingerprint another chunk has too,
    with the number that tells them apart. A fingerprint of a single chunk is its verified identifier as it is."""
    distinct = bodies.groupBy("fingerprint", "chunk").agg(F.count("*").alias("uses"))
    shared = distinct.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    contested = distinct.join(shared, "fingerprint", "left_semi")
    order = Window.partitionBy("fingerprint").orderBy("chunk")
    return contested.select("fingerprint", "chunk", F.row_number().over(order).cast("long").alias("variant"))


def recipes(texts: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """``texts`` (id, text, text_sha256) with ``recipe``, the ordered list of verified chunk identifiers."""
    cut = texts.withColumn("chunks", chunks(F.col("text"), least, most))
    # an inner explode would be guarded by filters that cut the text again
    bodies = cut.select(F.explode_outer("chunks").alias("chunk")).filter("chunk IS NOT NULL")
    bodies = bodies.select(fingerprint(F.col("chunk"), bits).alias("fingerprint"), "chunk")
    contested = stage(chunk_identifiers(bodies), "contested-chunks")
    plain = cut.select(
        "id", "text_sha256", F.transform("chunks", lambda c: fingerprint(c, bits)).alias("recipe")
    )
    if contested.isEmpty():
        return plain
    pieces = cut.select("id", "text_sha256", F.posexplode_outer("chunks").alias("at", "chunk")).distinct()
    pieces = pieces.withColumn("fingerprint", fingerprint(F.col("chunk"), bits))
    named = pieces.join(contested, ["fingerprint", "chunk"], "left").groupBy("id", "text_sha256")
    pair = F.struct("at", "fingerprint", F.coalesce("variant", F.lit(0)).alias("variant"))
    rebuilt = named.agg(F.sort_array(F.collect_list(F.when(F.col("chunk").isNotNull(), pair))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: F.array(p["fingerprint"], p["variant"])))
    rebuilt = rebuilt.select(F.col("id").alias("rid"), F.col("text_sha256").alias("rsha"), flat.alias("recipe"))
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("text_sha256") == F.col("rsha"))
    return plain.drop("recipe").join(rebuilt, same).select("id", "text_sha256", "recipe")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 30, most: int = 150,
                bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    texts = texts.withColumn("text_sha256", F.sha2("text", 256))
    listed = stage(recipes(texts, least, most, bits), "recipes")
    groups = listed.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return listed.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    stay = exact_dedup(docs, id_col, text_col, **options).filter("kept")
    stay = stay.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    marked = docs.withColumn("_hash", F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_sha"))
    one = Window.partitionBy(id_col, "_hash").orderBy(F.lit(0))
    kept = marked.join(stay, same, "left_semi").withColumn("_rank", F.row_number().over(one))
    return kept.filter("_rank = 1").drop("_hash", "_rank")
