"""Tables that grow by commits: versions, lookups, writers at the same time, writers that are lost."""

import datetime as dt
import hashlib
import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolesieve.operators.dedup import dedup_unseen, known_in_table
from rolesieve.operators.postings import with_hash
from rolesieve.sources import committed, files
from rolesieve.sources.committed import CommittedTable
from rolesieve.sources.seen import append_seen, compact_seen, count_seen, read_seen, seen_table
from rolesieve.sources.target import TARGET_SCHEMA, read_target, target_table, upsert_new_rows
from tests.helpers import posting, postings, tree

DAY = dt.date(2024, 6, 30)


def h(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def hashes(spark, values):
    return spark.createDataFrame([(h(i),) for i in values], "hash string")


def held(spark, path):
    return Counter(r.hash for r in read_seen(spark, path).collect())


def once(values):
    return Counter(h(i) for i in values)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "state")


def test_versions_and_counts(spark, path):
    assert count_seen(spark, path) == 0 and seen_table(spark, path).snapshot().version == 0
    assert append_seen(hashes(spark, range(50)), path) == 50
    assert append_seen(hashes(spark, range(30, 80)), path) == 30
    assert append_seen(hashes(spark, range(80)), path) == 0
    assert seen_table(spark, path).snapshot().version == 2  # nothing new, no commit
    assert held(spark, path) == once(range(80)) and count_seen(spark, path) == 80


def test_count_reads_no_hash(spark, path, monkeypatch):
    append_seen(hashes(spark, range(50)), path)
    compact_seen(spark, path)
    monkeypatch.setattr(CommittedTable, "_rows", None)
    assert count_seen(spark, path) == 50


def test_compaction(spark, path):
    hashes(spark, [*range(100), 1, 2]).write.parquet(path)  # files from before the first commit, with repeats
    append_seen(hashes(spark, range(90, 150)), path)
    assert compact_seen(spark, path, folder_rows=8) == 150
    (segment,) = seen_table(spark, path).snapshot().segments
    assert segment.prefix == 2 and sum(segment.folders.values()) == 150
    assert held(spark, path) == once(range(150))
    assert compact_seen(spark, path) == 150 and len(seen_table(spark, path).snapshot().segments) == 1
    # a folder is sorted
    for prefix in list(segment.folders)[:5]:
        part = spark.read.parquet(f"{path}/_segments/{segment.name}/_prefix={prefix}").collect()
        assert [r.hash for r in part] == sorted(h(i) for i in range(150) if h(i).startswith(prefix))
    assert append_seen(hashes(spark, range(140, 160)), path) == 10
    assert held(spark, path) == once(range(160))


@pytest.mark.parametrize("step", ["_commit", "_keys_of", "_drop"])
def test_a_lost_compaction_changes_nothing(spark, path, monkeypatch, step):
    append_seen(hashes(spark, range(40)), path)
    append_seen(hashes(spark, range(40, 60)), path)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(CommittedTable, step, fail)
        if step == "_drop":
            compact_seen(spark, path)  # nothing to remove: old segments stay until vacuum
        else:
            with pytest.raises(RuntimeError):
                compact_seen(spark, path)
    assert held(spark, path) == once(range(60)) and count_seen(spark, path) == 60
    assert compact_seen(spark, path) == 60 and append_seen(hashes(spark, range(70)), path) == 10
    table = seen_table(spark, path)
    needed = {s.name for s in table.snapshot().segments}
    assert table.vacuum(older_than=3600) == 0
    assert table.vacuum(older_than=-60) > 0
    assert set(files.list_files(spark, f"{path}/_segments")) == set(files.list_files(spark, f"{path}/_filters")) == needed
    assert held(spark, path) == once(range(70))


@pytest.mark.parametrize("step", ["_commit", "known"])
def test_a_lost_writer_adds_nothing(spark, path, monkeypatch, step):
    append_seen(hashes(spark, range(10)), path)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(CommittedTable, step, fail)
        with pytest.raises(RuntimeError):
            append_seen(hashes(spark, range(20)), path)
    assert held(spark, path) == once(range(10))
    assert append_seen(hashes(spark, range(20)), path) == 10 and held(spark, path) == once(range(20))


def test_what_others_add_during_compaction_stays(spark, path, monkeypatch):
    append_seen(hashes(spark, range(10)), path)
    append_seen(hashes(spark, range(10, 20)), path)
    write = CommittedTable._write

    def slow(self, rows, prefix=0):
        made = write(self, rows, prefix)
        if prefix:
            append_seen(hashes(spark, range(15, 30)), path)
        return made

    monkeypatch.setattr(CommittedTable, "_write", slow)
    assert compact_seen(spark, path) == 30
    assert held(spark, path) == once(range(30)) and len(seen_table(spark, path).snapshot().segments) == 2


def test_of_two_compactions_one_counts(spark, path, monkeypatch):
    for i in range(3):
        append_seen(hashes(spark, range(10 * i, 10 * i + 10)), path)
    write, nested = CommittedTable._write, []

    def slow(self, rows, prefix=0):
        made = write(self, rows, prefix)
        if prefix and not nested:
            nested.append(0)
            nested[0] = compact_seen(spark, path)
        return made

    monkeypatch.setattr(CommittedTable, "_write", slow)
    assert compact_seen(spark, path) == 30 and nested == [30]
    assert held(spark, path) == once(range(30)) and len(files.list_files(spark, f"{path}/_segments")) == 4


def test_an_overtaken_writer_adds_only_the_rest(spark, path, monkeypatch):
    """Others commit between the first look at the table and the commit, once by appending, once by compacting."""
    append_seen(hashes(spark, range(10)), path)
    write, nested = CommittedTable._write, []

    def slow(self, rows, prefix=0):
        made = write(self, rows, prefix)
        if not nested:
            nested.append(1)
            append_seen(hashes(spark, range(5, 25)), path)
            compact_seen(spark, path)
            append_seen(hashes(spark, range(40, 45)), path)
        return made

    monkeypatch.setattr(CommittedTable, "_write", slow)
    assert append_seen(hashes(spark, range(20, 50)), path) == 20
    assert held(spark, path) == once(range(50))


def test_versions_that_vacuum_removed_are_not_taken_again(spark, path):
    table = seen_table(spark, path)
    old = table.snapshot()
    for i in range(3):
        append_seen(hashes(spark, [i]), path)
    table.vacuum(older_than=-60)
    assert len(files.list_files(spark, f"{path}/_log")) == 1
    assert table.append(hashes(spark, [2, 7]), absent_from=old) == 1
    assert held(spark, path) == once([0, 1, 2, 7])


def test_two_runs_at_once_append_each_hash_once(spark, tmp_path):
    target = str(tmp_path / "target")
    rows = [posting(i, f"Title {i}") for i in range(60)]
    added, errors = [], []

    def run(part):
        try:
            added.append(upsert_new_rows(postings(spark, *part), target, DAY))
        except Exception as error:  # shown by the assertion below
            errors.append(error)

    runs = [threading.Thread(target=run, args=(part,)) for part in (rows[:40], rows[20:], rows[10:50])]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert not errors and sum(added) == 60
    titles = Counter(r["Title"] for r in read_target(spark, target).collect())
    assert titles == Counter(f"Title {i}" for i in range(60))
    assert target_table(spark, target).count() == 60


def test_a_batch_is_appended_once(spark, tmp_path):
    target = str(tmp_path / "target")
    first, other = postings(spark, posting(1, "A"), posting(2, "B")), postings(spark, posting(3, "C"))
    assert upsert_new_rows(first, target, DAY, batch="q-0") == 2
    assert upsert_new_rows(other, target, DAY, batch="q-0") == 0
    assert upsert_new_rows(first, target, DAY, batch="q-1") == 0  # remembered although it added nothing
    assert upsert_new_rows(other, target, DAY, batch="q-1") == 0
    assert upsert_new_rows(other, target, DAY, batch="q-2") == 1
    assert target_table(spark, target).snapshot().batches == ("q-0", "q-1", "q-2")


def test_rows_without_hash_survive_compaction(spark, tmp_path):
    target = str(tmp_path / "target")
    columns = [c.split("`")[1] for c in TARGET_SCHEMA.split(", ")]
    spark.createDataFrame([[v if c == "Hash" else "x" for c in columns] for v in ("", "", None, " h1 ", "h1", "h2")], TARGET_SCHEMA).write.parquet(target)
    table = target_table(spark, target)
    table.append(spark.createDataFrame([["h1" if c == "Hash" else "y" for c in columns]], TARGET_SCHEMA))
    table.append(spark.createDataFrame([["h3" if c == "Hash" else "y" for c in columns]], TARGET_SCHEMA))
    table.compact()
    assert Counter((r["Hash"] or "").strip() for r in read_target(spark, target).collect())["h3"] == 1
    assert sum(not r["Hash"] for r in read_target(spark, target).collect()) == 3


def test_lookup_reads_only_folders_that_may_hold_a_hash(spark, path, monkeypatch):
    append_seen(hashes(spark, range(400)), path)
    compact_seen(spark, path, folder_rows=32)
    append_seen(hashes(spark, range(400, 500)), path)
    table = seen_table(spark, path)
    compacted, later = table.snapshot().segments
    keys = spark.createDataFrame([(h(i),) for i in (3, 7, 10_000, 10_001)], "key string")
    found = table.candidates(keys, table.snapshot())
    assert set(found) == {compacted.name} and {h(3)[:1], h(7)[:1]} <= set(found[compacted.name])
    known = table.known(keys)
    assert {r.key for r in known.collect()} == {h(3), h(7)}
    plan = tree(known)
    (pruned,) = set(re.findall(r"PartitionFilters: \[([^\]]*)\]", plan))
    assert later.name not in known._jdf.queryExecution().toString()
    assert set(re.findall(r"\b([0-9a-f])\b", pruned.split("IN")[-1].split("=")[-1])) == set(found[compacted.name])
    # no candidate at all: nothing is read
    none = table.known(spark.createDataFrame([(h(20_000),)], "key string"))
    assert none.count() == 0 and "FileScan" not in tree(none)
    # a filter that always says yes changes what is read, not the answer
    monkeypatch.setattr(committed, "_holds", lambda bits, key: F.lit(True))
    assert {r.key for r in table.known(keys).collect()} == {h(3), h(7)}


@pytest.mark.parametrize("always", [False, True])
def test_unseen_postings(spark, path, monkeypatch, always):
    if always:
        monkeypatch.setattr(committed, "_holds", lambda bits, key: F.lit(True))
    rows = postings(spark, *[posting(i, f"T{i}") for i in range(40)])
    append_seen(with_hash(rows).filter("seq % 3 = 0").select("hash"), path)
    compact_seen(spark, path, folder_rows=1)
    append_seen(with_hash(rows).filter("seq % 5 = 0").select("hash"), path)
    table = seen_table(spark, path)
    new = dedup_unseen(rows, known_in_table(rows, table, table.snapshot()))
    assert sorted(r.seq for r in new.collect()) == [i for i in range(40) if i % 3 and i % 5]


def test_filters_hold_all_keys_and_few_others(spark, path):
    append_seen(spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash")), path)
    (segment,) = seen_table(spark, path).snapshot().segments
    assert segment.blocks == 8
    bits = spark.read.parquet(f"{path}/_filters/{segment.name}")
    keys = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("key"))
    maybe = keys.withColumn("block", committed._block(F.col("key"), F.lit(8).cast("long"))).join(bits, "block")
    got = [r.id for r in maybe.filter(committed._holds(F.col("bits"), F.col("key"))).select("id").collect()]
    assert sum(i < 20_000 for i in got) == 20_000 and sum(i >= 20_000 for i in got) < 0.02 * 40_000


def test_files_are_created_once(spark, tmp_path):
    name = str(tmp_path / "log" / "1.json")
    assert files.create_once(spark, name, "ä") and not files.create_once(spark, name, "b")
    assert files.read_text(spark, name) == "ä" and list(files.list_files(spark, str(tmp_path / "log"))) == ["1.json"]
    assert files.list_files(spark, str(tmp_path / "none")) == {}


def test_appended_rows_are_computed_once(spark, path):
    """Looking the keys up does not run the plan of the rows again."""
    append_seen(hashes(spark, range(50)), path)
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for part in batches:
            asked.add(part.num_rows)
            yield part

    rows = hashes(spark, range(30, 100)).mapInArrow(counted, "hash string")
    assert append_seen(rows, path) == 50 and asked.value == 70
    assert {r.hash for r in read_seen(spark, path).collect()} == {h(i) for i in range(100)}
    # what the rows were kept in meanwhile is gone
    needed = {s.name for s in seen_table(spark, path).snapshot().segments}
    assert set(files.list_files(spark, f"{path}/_segments")) == needed


@pytest.mark.parametrize("compacted", [False, True])
def test_a_segment_smaller_than_the_batch_is_read_without_its_filters(spark, path, monkeypatch, compacted):
    append_seen(hashes(spark, range(40)), path)
    append_seen(hashes(spark, range(40, 50)), path)
    if compacted:
        compact_seen(spark, path)
    asked = []
    candidates = CommittedTable.candidates
    monkeypatch.setattr(
        CommittedTable, "candidates",
        lambda self, keys, snapshot: asked.append(sorted(s.rows for s in snapshot.segments)) or candidates(self, keys, snapshot),
    )

    def known(values):
        keys = hashes(spark, values).select(F.col("hash").alias("key"))
        return Counter(r.key for r in seen_table(spark, path).known(keys).collect())

    assert known(range(30, 130)) == once(range(30, 50))
    assert known([*range(45, 57), *range(100, 110)]) == once(range(45, 50))
    assert known([3, 1000]) == once([3])
    assert known([]) == Counter()
    assert asked == ([[], [50], [50], [50]] if compacted else [[], [40], [10, 40], [10, 40]])


def test_null_and_repeated_keys_beside_a_smaller_segment(spark, path):
    append_seen(hashes(spark, range(3)), path)
    keys = spark.createDataFrame([(None,), ("",), (h(1),), (h(1),), (h(9),)], "key string")
    assert [r.key for r in seen_table(spark, path).known(keys).collect()] == [h(1)]
