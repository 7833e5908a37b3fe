"""A Merkle manifest of a table, and proofs of its rows by a recursive query.

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves of a group (here: a language) in
order of their id form a tree of runs of eight; the roots of the groups, in order of the group, form the tree above
them. The levels are stored as rows: a node with its children's digests and a link to its parent.

``climb`` is Spark's recursive query. It starts from the rows of the leaves, follows the parent links and at each step
appends the siblings that a node brings and folds the claimed digests with them. Leaves of one run share all siblings
above it, so the eight of them climb in one row, each with a digest of its own; that keeps what a step moves at an
eighth.

Leaves are numbered without a window over a group: they are sorted by ranges into files, and a leaf's number is its row
in its file plus the counts of the files before it. Groups of any size spread over tasks; a group of copies is sorted by
the row's place in the input as well.

Edge cases: a null field is ``-``, an empty one ``0:``; null ids come first, ids that are repeated go by leaf digest (so
equal rows are interchangeable); the null group comes first; an empty table has an empty manifest and no root; a group
of one leaf is that leaf, a table of one group has that group's root. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import new_folder

RUN = 8
TOP = "^"
#: One node: which tree, how many levels above the leaves, its number there, how many nodes that level has.
NODE = ["tree", "level", "idx", "width", "hash", "children", "up_tree", "up_level", "up_idx", "slot"]


@dataclass(frozen=True)
class Manifest:
    """Where a manifest lies: ``leaves`` holds runs of leaves, ``nodes`` the levels above; ``root`` is null if empty."""

    spark: SparkSession
    folder: str
    root: str | None

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/runs")

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes")


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("maxRecordsPerFile", 0).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row's fields: ``-`` if null, else the count of bytes, a colon and the value."""
    parts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return digest(F.concat(*told))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def group_name(group: Column) -> Column:
    """A name that sorts as the group does, null first; no group has the name of the tree above all."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[Column], path: str) -> DataFrame:
    """``rows`` with idx, their number within ``tree``, and width, the rows of the tree. Writes the sorted rows."""
    spread = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_at")
    ordered = written(spread.sortWithinPartitions("tree", *order, "_at").drop("_at"), path)
    part = F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).cast("long")
    placed = ordered.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    # a row for each tree of each file
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    starts = counts.select(
        "tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_rows").over(whole).alias("width"),
    )
    found = placed.join(starts, ["tree", "_part"])
    return found.withColumn("idx", F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")


def runs_of(nodes: DataFrame) -> tuple[Column, Column]:
    """The grouping of nodes (idx, width, hash) into runs, and a run's digests in order."""
    members = F.sort_array(F.collect_list(F.struct("idx", "hash")))
    return F.floor(F.col("idx") / RUN), F.array_join(F.transform(members, lambda m: as_hex(m["hash"])), "")


def levels_above(nodes: DataFrame, widest: int, path: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, idx, width, hash), lowest first, each of them written."""
    levels = []
    while widest > 1:
        number, digests = runs_of(nodes)
        grouped = nodes.filter("width > 1").groupBy("tree", number.alias("idx"))
        made = grouped.agg(digests.alias("told"), F.ceil(F.max("width") / RUN).alias("width"))
        level = F.lit(len(levels) + 1).alias("level")
        made = made.select("tree", level, "idx", "width", digest(F.col("told")).alias("hash"), F.unhex("told").alias("children"))
        nodes = written(made, f"{path}-{len(levels) + 1}")
        levels.append(nodes)
        widest = -(-widest // RUN)
    return levels


def linked(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """``nodes`` with the links to their parents. ``above``: tree and its number ``rank`` among the trees, if the tops of
    these trees have parents."""
    inside = F.col("width") > 1
    links = [
        F.when(inside, F.col("tree")), F.when(inside, F.col("level") + 1),
        F.when(inside, F.floor(F.col("idx") / RUN)), F.when(inside, F.pmod("idx", F.lit(RUN)).cast("int")),
    ]
    if above is None:
        return nodes.select(*NODE[:6], *[c.alias(n) for c, n in zip(links, NODE[6:], strict=True)])
    # one row for each tree meets the one top of that tree
    lower = linked(nodes.filter(inside), None)
    tops = nodes.filter(~inside).join(above, "tree").select(
        *NODE[:6], F.lit(TOP).alias("up_tree"), F.lit(1).alias("up_level"),
        F.floor(F.col("rank") / RUN).alias("up_idx"), F.pmod("rank", F.lit(RUN)).cast("int").alias("slot"),
    )
    return lower.unionByName(tops)


def write_manifest(rows: DataFrame, group: Column, key: str, leaf: Column, claimed: Column | None = None,
                   folder: str | None = None) -> Manifest:
    """The manifest of ``rows``: leaves of digest ``leaf`` in order of column ``key`` within ``group``. ``claimed`` is the
    digest that is later checked for a row, the leaf itself by default."""
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "merkle")
    # digests are made once; what is sorted is narrow
    leaves = rows.select(group_name(group).alias("tree"), F.col(key).alias("key"), leaf.alias("hash"), (leaf if claimed is None else claimed).alias("claimed"))
    leaves = written(leaves, f"{folder}/digests")
    order = [F.col("key").asc_nulls_first(), F.col("hash")]
    placed = numbered(leaves, order, f"{folder}/ordered")
    number, digests = runs_of(placed)
    members = F.sort_array(F.collect_list(F.struct("idx", "hash", "key", "claimed")))
    runs = placed.groupBy("tree", number.alias("idx")).agg(members.alias("members"), F.max("width").alias("leaves"))
    runs = written(runs, f"{folder}/runs")
    widest = runs.agg(F.max("leaves")).first()[0] or 0

    # the lowest level comes from the runs; a lone leaf stands for its tree
    told = F.array_join(F.transform("members", lambda m: as_hex(m["hash"])), "")
    lone = F.col("leaves") == 1
    first = runs.select(
        "tree", F.when(lone, 0).otherwise(1).alias("level"), "idx", F.ceil(F.col("leaves") / RUN).alias("width"),
        F.when(lone, F.col("members")[0]["hash"]).otherwise(digest(told)).alias("hash"), F.unhex(told).alias("children"),
    )
    first = written(first, f"{folder}/level-first")
    higher = levels_above(first.select("tree", "idx", "width", "hash"), -(-widest // RUN), f"{folder}/level-group")
    nodes = first
    for made in higher:
        nodes = nodes.unionByName(made.withColumn("level", F.col("level") + 1))

    tops = nodes.filter("width = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "hash")
    trees = numbered(tops, [F.col("group")], f"{folder}/groups")
    count = trees.agg(F.max("width")).first()[0] or 0
    if count > 1:
        table = linked(nodes, trees.select(F.col("group").alias("tree"), F.col("idx").alias("rank")))
        for made in levels_above(trees.drop("group"), count, f"{folder}/level-top"):
            table = table.unionByName(linked(made, None))
    else:
        table = linked(nodes, None)
    table = written(table, f"{folder}/nodes")
    found = table.filter("up_tree IS NULL").select(as_hex(F.col("hash"))).first()
    return Manifest(spark, folder, found[0] if found else None)


#: Each step appends the siblings in the parent's row and folds the claimed digests with them.
CLIMB = f"""
    WITH RECURSIVE climb AS (
        SELECT r.tree, r.idx, n.up_tree, n.up_level, n.up_idx, n.slot, IF(n.width = 1, n.hash, NULL) AS subroot,
            CAST('' AS BINARY) AS above,
            IF(r.leaves = 1, transform(r.members, m -> m.claimed), transform(r.members, (m, i) -> unhex(sha2(
                array_join(transform(r.members, (s, j) -> lower(hex(IF(i = j, s.claimed, s.hash)))), ''), 256)))) AS folded
        FROM {{runs}} r JOIN {{nodes}} n ON n.tree = r.tree AND n.idx = r.idx AND n.level = IF(r.leaves = 1, 0, 1)
        UNION ALL
        SELECT c.tree, c.idx, n.up_tree, n.up_level, n.up_idx, n.slot,
            IF(n.width = 1 AND n.tree = c.tree, n.hash, c.subroot),
            concat(c.above, substring(n.children, 1, 32 * c.slot), substring(n.children, 32 * c.slot + 33)),
            transform(c.folded, f -> unhex(sha2(lower(hex(concat(
                substring(n.children, 1, 32 * c.slot), f, substring(n.children, 32 * c.slot + 33)))), 256)))
        FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx
    )
    SELECT tree, idx, subroot, above, folded FROM climb WHERE up_tree IS NULL LIMIT ALL
"""


def climb(manifest: Manifest) -> DataFrame:
    """Per run of leaves (tree, idx): subroot, ``above``, the siblings above the run in order, and ``folded``, the root
    that each leaf's claimed digest leads to."""
    return manifest.spark.sql(CLIMB, runs=manifest.runs(), nodes=manifest.nodes())


def prove(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """Per leaf: key, leaf, subroot, root, proof_sha256 (of all siblings, lowest first), folded_root, verified."""
    joined = manifest.runs().join(climb(manifest), ["tree", "idx"])
    pairs = F.posexplode(F.arrays_zip("members", "folded")).alias("at", "one")
    each = joined.select("members", "subroot", "above", pairs)
    siblings = F.filter("members", lambda m, i: i != F.col("at"))
    told = F.concat(F.array_join(F.transform(siblings, lambda m: as_hex(m["hash"])), ""), as_hex(F.col("above")))
    folded = as_hex(F.col("one.folded"))
    return each.select(
        F.col("one.members.key").alias(key),
        as_hex(F.col("one.members.hash")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        F.lit(manifest.root).alias("root"),
        F.sha2(told, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.lit(manifest.root)).alias("verified"),
    )


def audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang",
          fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """A manifest of ``docs`` and the proof of every row, where rows whose id's CRC-32 is divisible by 3 claim a text
    whose A-Z are lower-cased."""
    tampered = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    columns = [F.col(c) for c in fields]
    changed = [lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in fields]
    leaf = leaf_digest(columns)
    claimed = F.when(tampered, leaf_digest(changed)).otherwise(leaf)
    return prove(write_manifest(docs, F.col(group_col), id_col, leaf, claimed), id_col)
