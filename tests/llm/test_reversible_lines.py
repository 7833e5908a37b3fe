"""Line dedup against a plain version: whole tables, growing and shrinking indexes, odd rows, the filter itself."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from rolesieve.llm import line_dedup
from rolesieve.llm.line_dedup import CuckooFilter, LineIndex, dedup, keyed, rewrite
from rolesieve.llm.queries import op11_line_dedup

SCHEMA = "doc_id long, text string, n_lines string, row string"


def line(i):
    return f"line number {i:05d} of the corpus"


def key(text):
    stripped = text.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def plain(docs, held, min_docs=3):
    """What ``docs`` keep where the documents ``held`` count."""
    holders = {}
    for at, (i, text) in enumerate(held):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, []).append((i is not None, i or 0, at))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            own = holders.get(key(x), [])
            if len(key(x)) < 20 or len(own) < min_docs or max(own)[:2] == (i is not None, i or 0):
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def rows_of(df):
    return Counter(tuple(r)[:2] + tuple(r)[-2:] for r in df.collect())


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, " \t"), (5, line(1)), (6, "  " + line(1).upper() + "\r"), (7, line(1) + "\n" + line(1)),
    (8, "short\nshort"), (9, "short"), (10, "short"), (11, "É" + "x" * 19 + "\né" + "x" * 19), (12, "É" + "x" * 19), (13, "É" + "x" * 19),
    (14, "漢" * 20), (15, "漢" * 20), (16, " 漢" + "漢" * 19), (17, "漢" * 19), (18, "漢" * 19), (19, "漢" * 19),
    (20, "\n".join(line(i % 700) for i in range(3000))), (21, " " + line(9)), (22, " " + line(9)), (23, " " + line(9)),
    (None, line(1)), (None, line(2)), (None, line(2)), (None, line(2)), (24, line(3)), (24, line(3)), (24, line(3) + "\nmore"),
]
MANY = [(100 + i, "\n".join(line(j) for j in range(i % 40, i % 40 + 12) if j % 3 or i % 2)) for i in range(120)]


def test_dedup_equals_plain(spark):
    docs = ODD + MANY
    got = dedup(frame(spark, docs))
    assert got.columns == ["doc_id", "text", "n_lines", "row", "n_lines", "n_dropped"]
    assert rows_of(got) == plain(docs, docs)


def test_empty_table(spark):
    assert dedup(frame(spark, [])).count() == 0


def test_query_gives_digests(spark, tmp_path):
    frame(spark, ODD + MANY).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, op11_line_dedup(spark, str(tmp_path)).collect()))
    expected = Counter()
    for (i, text, n, dropped), times in plain(ODD + MANY, ODD + MANY).items():
        expected[(i, n, dropped, hashlib.sha256(text.encode()).hexdigest())] += times
    assert got == expected


def counts_of(index):
    return {(r.k1, r.k2): (r.n_docs, r.owner) for r in index.counts().collect()}


def expected_counts(docs):
    found = {}
    for i, text in docs:
        for k in {line_dedup.line_key(x.encode(), 20) for x in (text or "").split("\n")} - {None}:
            a, b = np.frombuffer(k, np.int64).tolist()
            n, owner = found.get((a, b), (0, None))
            found[(a, b)] = (n + 1, i if owner is None else owner if i is None else max(i, owner))
    return found


def test_insertions_and_deletions(spark, tmp_path):
    """Counts, filters and answers after each step are those of the documents held then."""
    index = LineIndex(spark, str(tmp_path / "index"))
    held = []

    def check():
        assert counts_of(index) == expected_counts(held)
        docs = frame(spark, held or [(1, line(1))])
        got = rewrite(docs, index.dropped(keyed(docs)))
        assert rows_of(got) == plain([(r.doc_id, r.text) for r in docs.collect()], held)
        lines = expected_counts(held)
        sizes = Counter()
        for r in index.filters().collect():
            filter_ = CuckooFilter(slots=r.slots, held=r.held)
            least = 1 if r.kind == "seen" else 3
            mine = np.array([b for (a, b), (n, _) in lines.items() if a % 8 == r.shard and n >= least], np.int64)
            assert r.held == len(mine) == np.count_nonzero(filter_.table) and filter_.contains(mine).all()
            sizes[r.kind] += r.held
        assert sizes["seen"] == len(lines)

    for batch in (MANY[:50], MANY[50:] + ODD, []):
        index.insert(keyed(frame(spark, batch)))
        held += batch
        check()
    for gone in ({219, 218, 6, 7, 24, 5000}, {i for i, _ in held if i is not None and i % 2 == 0}, {i for i, _ in held if i is not None}):
        index.delete(spark.createDataFrame([(i,) for i in gone] + [(None,)], "doc_id long"))
        held = [(i, t) for i, t in held if i not in gone]
        check()
    index.insert(keyed(frame(spark, MANY)))
    held += MANY
    check()


def test_work_that_was_not_committed_is_not_read(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"))
    index.insert(keyed(frame(spark, MANY[:30])))
    before = counts_of(index)
    # a writer that was lost before its commit
    index._write(keyed(frame(spark, MANY[30:])), "refs", 1)
    index._write(spark.createDataFrame([(1, 1, 9, 9, 1)], line_dedup.COUNTS), "counts", 1)
    assert counts_of(index) == before and index.refs().count() == keyed(frame(spark, MANY[:30])).count()
    index.insert(keyed(frame(spark, MANY[30:])))
    assert counts_of(index) == expected_counts(MANY)


def test_more_shards_and_full_filters(spark, tmp_path, monkeypatch):
    index = LineIndex(spark, str(tmp_path / "index"))
    index.insert(keyed(frame(spark, MANY[:2])))
    # far more lines than the first filters have room for, first in the same shards, then in more of them
    index.insert(keyed(frame(spark, [(1000, "\n".join(line(i) for i in range(1000, 3000)))])))
    assert {r.shard for r in index.filters().collect()} <= set(range(8))
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 100)
    last = [(2000 + j, "\n".join(line(i) for i in range(2500, 4000))) for j in range(3)]
    index.insert(keyed(frame(spark, last)))
    filters = index.filters().collect()
    assert max(r.shard for r in filters) > 8
    assert counts_of(index) == expected_counts(MANY[:2] + [(1000, "\n".join(line(i) for i in range(1000, 3000)))] + last)
    assert sum(r.held for r in filters if r.kind == "repeated") == sum(n >= 3 for n, _ in counts_of(index).values())


@pytest.mark.parametrize("n", [0, 1, 7, 5000, 100_000])
def test_cuckoo_filter(n):
    random = np.random.default_rng(n)
    lines = np.unique(random.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))
    others = random.integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64)
    held = CuckooFilter(len(lines))
    half = len(lines) // 2
    assert held.insert(lines[:half]) and held.insert(lines[half:])
    assert held.contains(lines).all() and np.count_nonzero(held.table) == held.held == len(lines)
    assert held.contains(others).mean() < 1e-3
    held.delete(lines[:half])
    assert held.contains(lines[half:]).all() and held.contains(lines[:half]).sum() <= half / 100 and held.held == len(lines) - half
    again = CuckooFilter(slots=held.table.tobytes(), held=held.held)
    assert again.contains(lines[half:]).all()
    held.delete(lines[half:])
    assert not held.table.any()


def test_a_full_filter_says_so():
    held = CuckooFilter(10)
    assert not held.insert(np.arange(1000, dtype=np.int64) << 40)
    with pytest.raises(ValueError):
        CuckooFilter(10).delete(np.array([5], np.int64))
