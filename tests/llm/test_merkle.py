"""The Merkle manifest against a plain version: whole proofs of odd tables, stored levels, tampering."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolesieve.llm import merkle
from rolesieve.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree string, idx long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def fold(built, at, value):
    siblings = []
    for level in built[:-1]:
        run, k = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
        siblings += run[:k] + run[k + 1 :]
        value = h("".join([*run[:k], value, *run[k + 1 :]]))
        at //= 8
    return siblings, value


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda t: t[:3])
    built = {name: levels([t[2] for t in trees[name]]) for name in names}
    top = levels([built[name][-1][0] for name in names]) if names else []
    out = []
    for place, name in enumerate(names):
        for at, (_, _, own, row) in enumerate(trees[name]):
            claimed = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
                claimed = leaf((*row[:4], lowered))
            low, value = fold(built[name], at, claimed)
            high, value = fold(top, place, value)
            root = top[-1][0]
            out.append((row[0], own, built[name][-1][0], root, h("".join(low + high)), value, value == root))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)


MANY = [
    (None if i % 7 == 0 else i % 50, "s" if i % 4 else None, None if i % 11 == 0 else f"l{i % 13}", i % 3 or None, f"Text Ä {i % 20}" if i % 5 else None)
    for i in range(300)
] + [(1, "x", "solo", 1, ""), (2, "", "", 0, "A" * 70_000)]
CASES = {
    "eleven groups and copies": MANY,
    "empty": [],
    "one row": MANY[1:2],
    "a run": [(i, "s", "en", 1, "A") for i in range(8)],
    "a run and one": [(i, "s", "en", 1, "A") for i in range(9)],
    "runs of runs": [(i, "s", "en", 1, f"Row {i}") for i in range(65)] + [(9, None, "de", None, "Ende")],
    "copies only": [(5, "s", "en", 1, "Same")] * 40,
    "no ids": [(None, "s", None, 1, f"T{i % 3}") for i in range(20)],
}


@pytest.mark.parametrize("case", CASES)
def test_proofs_equal_plain(spark, case):
    got = merkle.audit(frame(spark, CASES[case]))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == plain(CASES[case])


def test_query(spark, tmp_path):
    frame(spark, MANY).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, op12_merkle_manifest(spark, str(tmp_path)).collect())) == plain(MANY)


def test_levels_are_stored_with_links(spark, tmp_path):
    """Every node but the root has a parent row that holds its digest at its slot, and a digest of its children."""
    docs = frame(spark, CASES["runs of runs"])
    made = merkle.write_manifest(docs, F.col("lang"), "doc_id", merkle.leaf_digest([F.col(c) for c in docs.columns[:5]]), folder=f"{tmp_path}/m")
    nodes = {(r.tree, r.level, r.idx): r for r in made.nodes().collect()}
    # 9 runs, 2 runs of runs and their top; a lone leaf; the top of both
    assert len(nodes) == 9 + 2 + 1 + 1 + 1
    for node in nodes.values():
        if node.up_tree is None:
            assert node.hash.hex() == made.root
            continue
        parent = nodes[(node.up_tree, node.up_level, node.up_idx)]
        assert bytes(parent.children[32 * node.slot : 32 * node.slot + 32]) == bytes(node.hash)
        assert h(parent.children.hex()) == parent.hash.hex()


def test_any_change_of_a_leaf_is_found(spark):
    docs = frame(spark, CASES["runs of runs"])
    columns = [F.col(c) for c in docs.columns[:5]]
    told = merkle.leaf_digest(columns)
    other = merkle.leaf_digest([*columns[:4], F.concat("text", F.lit(" "))])
    claimed = F.when(F.col("doc_id") % 10 == 3, other).otherwise(told)
    got = merkle.prove(merkle.write_manifest(docs, F.col("lang"), "doc_id", told, claimed)).collect()
    assert all(r.verified == (r.doc_id % 10 != 3) for r in got) and len(got) == 66


def test_fields_do_not_run_into_each_other(spark):
    rows = [(1, "ab", "c", 1, "t"), (1, "a", "bc", 1, "t"), (1, "-", "c", 1, "t"), (1, None, "c", 1, "t")]
    docs = frame(spark, rows)
    got = docs.select(merkle.as_hex(merkle.leaf_digest([F.col(c) for c in docs.columns[:5]]))).collect()
    assert [r[0] for r in got] == [leaf(r) for r in rows] and len(set(got)) == 4
