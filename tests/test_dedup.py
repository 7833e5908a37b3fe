from pyspark.sql import functions as F

from rolesieve.operators.dedup import dedup_first, dedup_unseen, known_hashes, new_hashes, seen_count, update_seen
from rolesieve.operators.postings import with_hash
from tests.helpers import posting, postings, tree


def seqs(df):
    return sorted(r.seq for r in df.collect())


def sample(spark):
    return postings(
        spark,
        posting(3, "A", "C", url="https://X/1"),
        posting(1, "a ", " c", url="https://x/1"),
        posting(2, "A", "C", url="https://x/2"),
        posting(4, "A", "D", url="https://x/1"),
    )


def test_first_by_order_survives(spark):
    assert seqs(dedup_first(sample(spark))) == [1, 2, 4]


def test_description_and_date_do_not_matter(spark):
    rows = postings(spark, posting(1, description="x"), posting(2, description="y", location="z"))
    assert seqs(dedup_first(rows)) == [1]


def test_against_earlier_runs(spark):
    rows = sample(spark)
    seen = with_hash(rows).filter("seq IN (3, 4)").select("hash")
    assert seqs(dedup_unseen(rows, seen)) == [2]
    assert seen_count(rows, seen).collect()[0].seen_count == 3
    assert update_seen(seen, rows).count() == update_seen(update_seen(seen, rows), rows).count() == 3
    assert new_hashes(seen, rows).count() == 1
    empty = spark.createDataFrame([], "hash string")
    assert seqs(dedup_unseen(rows, empty)) == [1, 2, 3, 4]
    assert seen_count(rows, empty).collect()[0].seen_count == 3


def hot(spark, n):
    """A third of all rows share one identity."""
    url = F.when(F.col("id") % 3 == 0, F.lit("https://hot")).otherwise(F.concat(F.lit("https://"), F.col("id") % 5000))
    return spark.range(n).select(
        (F.lit(n) - F.col("id")).alias("seq"), F.lit("T").alias("title"), F.lit("C").alias("company"),
        url.alias("posting_url"),
    )


def test_hot_identity_is_cut_before_the_shuffle(spark):
    rows = hot(spark, 60000)
    got = {r.posting_url: r.seq for r in dedup_first(rows).collect()}
    expected = {}
    for r in rows.collect():
        expected[r.posting_url] = min(r.seq, expected.get(r.posting_url, r.seq))
    assert got == expected
    plan = tree(dedup_first(rows))
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit") and "Partial" in plan


def test_anti_join_reuses_the_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tree(dedup_unseen(dedup_first(sample(spark)), with_hash(sample(spark)).select("hash")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(hash") == 2  # one per side, none between window and join


def test_small_batch_leaves_a_large_state_in_place(spark, tmp_path):
    with_hash(sample(spark)).write.parquet(str(tmp_path / "batch"))
    spark.range(200000).selectExpr("sha2(cast(id as string), 256) AS hash").write.parquet(str(tmp_path / "seen"))
    batch, seen = [spark.read.parquet(str(tmp_path / n)) for n in ("batch", "seen")]
    known = known_hashes(batch, seen)
    plan = tree(known)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert seqs(dedup_unseen(batch, known)) == seqs(dedup_unseen(batch, seen)) == [1, 2, 3, 4]
    wider = seen.unionByName(batch.filter("seq = 2").select("hash"))
    assert seqs(dedup_unseen(batch, known_hashes(batch, wider))) == [1, 3, 4]
