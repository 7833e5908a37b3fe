"""Classes of near copies where a bucket is dealt over many tasks, and what such a bucket makes of rows."""

import itertools

import numpy as np
import pytest

from rolesieve.llm import minhash


def rows_of_one_passage(n: int, own: int, common: int = 200) -> list[tuple[int, str]]:
    """Texts with one passage in common and words of their own: a center with none, and copies less like each other."""
    passage = " ".join(f"p{k}" for k in range(common))
    return [(0, passage)] + [(i, f"{passage} " + " ".join(f"o{i}x{k}" for k in range(own))) for i in range(1, n)]


def brute_force(frame, rows):
    idf = minhash.document_frequencies(frame, "text")
    sets = [minhash.weighted_shingles(t, idf) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if label[a] != label[b] and minhash.similarity(sets[a], sets[b]) >= minhash.THRESHOLD:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    return {rows[i][0]: rows[x][0] for i, x in enumerate(label)}


@pytest.mark.parametrize("tile", [1024, 5])
def test_classes_do_not_depend_on_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "HUBS", 1)
    rows = rows_of_one_passage(30, 8) + [(100 + i, f"{t} z z z z") for i, t in rows_of_one_passage(12, 60, 90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(frame, rows)
    assert 1 < len(set(want.values())) < len(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_classes(frame).collect()}
    assert got == want


def test_a_bucket_makes_no_rows_of_pairs(spark, monkeypatch):
    """A hundred texts that share most of their words: most pairs share a band, none is a link."""
    made, stage = {}, minhash.stage

    def counted(df, kind):
        table = stage(df, kind)
        made[kind] = max(made.get(kind, 0), table.count())
        return table

    monkeypatch.setattr(minhash, "stage", counted)
    rows = rows_of_one_passage(100, 12)[1:]
    got = minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r.class_id for r in got.collect()}) == 99
    # every text is in ten bands at most
    assert max(made.values()) <= 990, made


def test_bitmap_of_members_keeps_them(spark):
    texts = spark.range(2000).selectExpr("md5(cast(id AS string)) AS node", "cast(id AS string) AS text")
    members = texts.filter("cast(text AS int) % 100 = 0").select("node")
    kept = {int(r.text) for r in minhash.maybe_members(texts, members).collect()}
    assert set(range(0, 2000, 100)) <= kept and len(kept) < 40 and np.all(np.array(list(kept)) < 2000)
