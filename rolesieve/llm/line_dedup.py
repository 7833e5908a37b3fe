"""Line dedup that can be undone: exact reference counts of lines, fronted by sharded cuckoo filters.

A line is known by the 128-bit digest of its key: the line without blanks at both ends, A-Z lower-cased. A ``LineIndex``
lies in a folder and grows by versions. Each version appends rows to the exact tables: ``refs`` (line, document),
``counts`` (line, number of documents, owner: the largest id), ``gone`` (documents deleted), and replaces the filters
of the shards it touched. A commit row makes it visible, so a job that was lost leaves nothing behind that is read.

Two cuckoo filters a shard hold 16-bit fingerprints: ``seen`` of lines that any document holds, ``repeated`` of those
that ``min_docs`` hold. Inserting documents looks up exact counts only for lines that ``seen`` may hold; finding the
lines to drop only for lines that ``repeated`` may hold. Both answers are then exact. Deleting documents takes their
references back, moves owners, and takes fingerprints out again, which a cuckoo filter can do: every line went in once.
A filter too full for more is rebuilt from the exact table.

Filters only ever meet distinct lines with their counts, summed before the shuffle, so a line of a third of all
documents is one row for each task. Where references meet the lines to drop, lines that hold more than a thousandth of
all references (a thousand of them at most) are broadcast.

Edge cases: a null or empty text is one empty line; lines keep their exact text; every row is a document, so rows that
repeat an id count each, and all rows of the owner's id keep their lines; a null id is smaller than any other, rows
without id keep a line only if no row with an id holds it, and cannot be deleted; deleting an unknown id does nothing;
an empty table gives an empty index. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rolesieve.llm.common import new_folder
from rolesieve.sources.tables import read_parquet_or_empty

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Filters are built this full at most, and take new lines until FULL.
FILL, FULL = 0.8, 0.92
#: Lines of a shard on average when shards are chosen.
SHARD_LINES = 1 << 20
#: Lines with more than this share of all references are broadcast; there can be 1 / HEAVY of them.
HEAVY = 1 / 1000
LINE = ["k1", "k2"]
REFS = "k1 bigint, k2 bigint, doc_id bigint, text_hash bigint"
COUNTS = "k1 bigint, k2 bigint, n_docs bigint, owner bigint, version bigint"
FILTERS = "shard bigint, kind string, held bigint, slots binary, version bigint"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(BLANKS).lower()  # of bytes: A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each line has two buckets. All operations take arrays of lines."""

    def __init__(self, lines: int = 0, slots: bytes | None = None, held: int = 0):
        if slots is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, lines) / (SLOTS * FILL)))))
            self.table = np.zeros((buckets, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.held = held

    def places(self, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket."""
        bits = k2.astype(np.int64).view(np.uint64)
        print_ = (bits >> np.uint64(48)).astype(np.uint16)
        return np.where(print_ == 0, np.uint16(1), print_), (bits & np.uint64(len(self.table) - 1)).astype(np.int64)

    def other(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint: an odd step, so that the two differ, found from either."""
        step = (prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)).astype(np.int64) | 1
        return buckets ^ (step & (len(self.table) - 1))

    def contains(self, k2: np.ndarray) -> np.ndarray:
        prints, first = self.places(k2)
        second = self.other(prints, first)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, k2: np.ndarray) -> bool:
        """Enter lines that are not held yet; False if there is no room (the filter is then to be rebuilt)."""
        if self.held + len(k2) > FULL * self.table.size:
            return False
        self.held += len(k2)
        prints, buckets = self.places(k2)
        random = np.random.default_rng(len(k2))
        for turn in range(1000):
            if not len(prints):
                return True
            order = np.argsort(buckets, kind="stable")
            prints, buckets = prints[order], buckets[order]
            begins = np.searchsorted(buckets, buckets)
            rank = np.arange(len(buckets)) - begins
            free = self.table[buckets] == 0
            fits = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
            placed = fits.any(axis=1)
            self.table[buckets[placed], fits[placed].argmax(axis=1)] = prints[placed]
            prints, buckets, rank = prints[~placed], buckets[~placed], rank[~placed]
            if turn:
                # the first of each bucket takes the place of one that is there, which moves on
                first = np.flatnonzero(np.diff(buckets, prepend=-1))
                slot = random.integers(0, SLOTS, len(first))
                pushed = self.table[buckets[first], slot]
                self.table[buckets[first], slot] = prints[first]
                prints = prints.copy()
                prints[first] = pushed
            buckets = self.other(prints, buckets)
        return False

    def delete(self, k2: np.ndarray) -> None:
        """Take out lines that are held, one fingerprint each."""
        self.held -= len(k2)
        prints, first = self.places(k2)
        second = self.other(prints, first)
        while len(prints):
            # lines that share fingerprint and buckets take turns
            name = np.minimum(first, second) * 65536 + prints
            _, now = np.unique(name, return_index=True)
            p, b = prints[now], first[now]
            here = self.table[b] == p[:, None]
            b = np.where(here.any(axis=1), b, second[now])
            here = self.table[b] == p[:, None]
            if not here.any(axis=1).all():
                raise ValueError("a line to take out is not in the filter")
            self.table[b, here.argmax(axis=1)] = 0
            rest = np.ones(len(prints), bool)
            rest[now] = False
            prints, first, second = prints[rest], first[rest], second[rest]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """One row per document and distinct key of its lines: k1, k2, doc_id, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            digests, rows = [], []
            for at, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                keys = {line_key(line, min_chars) for line in text.split(b"\n")} if text else set()
                keys.discard(None)
                digests += keys
                rows += [at] * len(keys)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            columns = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), part.column(0).take(at), part.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc_id", "text_hash"])

    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col)).mapInArrow(run, REFS)


def shard_of(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).alias("shard")


class LineIndex:
    """The lines of a growing and shrinking set of documents, in ``folder``. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 3):
        self.spark, self.folder, self.min_docs = spark, folder, min_docs

    # reading -------------------------------------------------------------------------------------------------------

    def _commits(self) -> list:
        log = read_parquet_or_empty(self.spark, f"{self.folder}/log", "version bigint, shards bigint")
        # one row for each insertion or deletion
        return log.orderBy("version").collect()

    def _table(self, kind: str, schema: str, versions: list[int]) -> DataFrame:
        parts = [read_parquet_or_empty(self.spark, f"{self.folder}/{kind}/v{v}", schema) for v in versions]
        whole = self.spark.createDataFrame([], schema) if not parts else parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def counts(self) -> DataFrame:
        """The exact table: k1, k2, n_docs, owner of every line that a document holds."""
        versions = [c.version for c in self._commits()]
        rows = self._table("counts", COUNTS, versions)
        if len(versions) > 1:
            # the latest row of a line counts; within a version a line has one
            latest = F.max(F.struct("version", "n_docs", "owner")).alias("row")
            rows = rows.groupBy(LINE).agg(latest).select(*LINE, "row.n_docs", "row.owner")
        return rows.filter("n_docs > 0").select(*LINE, "n_docs", "owner")

    def refs(self) -> DataFrame:
        """(line, document) of all documents that are not deleted."""
        versions = [c.version for c in self._commits()]
        rows = None
        for v in versions:
            part = self._table("refs", REFS, [v])
            later = [w for w in versions if w > v]
            if later:
                part = part.join(self._table("gone", "doc_id bigint", later), "doc_id", "left_anti").select("k1", "k2", "doc_id", "text_hash")
            rows = part if rows is None else rows.unionByName(part)
        return self._table("refs", REFS, []) if rows is None else rows

    def filters(self) -> DataFrame:
        """The latest filters of every shard."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], FILTERS)
        first = max((c.version for c in commits if c.shards != commits[-1].shards), default=-1)
        rows = self._table("filters", FILTERS, [c.version for c in commits if c.version > first])
        row = F.max_by(F.struct(*[c.split()[0] for c in FILTERS.split(", ")]), "version").alias("row")
        return rows.groupBy("shard", "kind").agg(row).select("row.*")

    # filters -------------------------------------------------------------------------------------------------------

    def _probe(self, lines: DataFrame, kind: str, shards: int) -> DataFrame:
        """Distinct ``lines`` (k1, k2, n, top) that the filters of this kind may hold."""
        schema = lines.schema

        def run(some: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(filters) or not len(some):
                return some.iloc[:0].drop(columns="shard")
            row = filters.iloc[0]
            held = CuckooFilter(slots=row["slots"], held=int(row["held"]))
            return some[held.contains(some["k2"].to_numpy(np.int64))].drop(columns="shard")

        left = lines.select("*", shard_of(shards)).groupBy("shard")
        right = self.filters().filter(F.col("kind") == kind).groupBy("shard")
        return left.cogroup(right).applyInPandas(run, schema)

    def _build(self, counts: DataFrame, shards: int, version: int, only: list[int] | None = None) -> DataFrame:
        """Filters from exact counts. ``only``: these shards."""
        least = self.min_docs

        def run(part: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for kind, some in (("seen", part), ("repeated", part[part["n_docs"] >= least])):
                lines, made = len(some), CuckooFilter(len(some))
                while not made.insert(some["k2"].to_numpy(np.int64)):
                    lines = 2 * lines + 1
                    made = CuckooFilter(lines)
                rows.append((int(part["shard"].iloc[0]), kind, made.held, made.table.tobytes(), version))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in FILTERS.split(", ")])

        lines = counts.select(*LINE, "n_docs", shard_of(shards))
        if only is not None:
            lines = lines.filter(F.col("shard").isin(only))
        return lines.select("k2", "n_docs", "shard").groupBy("shard").applyInPandas(run, FILTERS)

    def _change(self, changes: DataFrame, shards: int, version: int) -> DataFrame:
        """Filters after ``changes`` (k1, k2, before, after: documents of a line). ``slots`` is null where a filter has
        no room."""
        least = self.min_docs

        def run(some: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            rows = []
            if len(some):
                k2, before, after = (some[c].to_numpy(np.int64) for c in ("k2", "before", "after"))
                old = {r.kind: r for r in filters.itertuples()}
                for kind, bound in (("seen", 1), ("repeated", least)):
                    row = old.get(kind)
                    enters, leaves = (before < bound) & (after >= bound), (before >= bound) & (after < bound)
                    held = CuckooFilter(int(enters.sum())) if row is None else CuckooFilter(slots=row.slots, held=int(row.held))
                    held.delete(k2[leaves])
                    room = held.insert(k2[enters])
                    rows.append((int(some["shard"].iloc[0]), kind, held.held, held.table.tobytes() if room else None, version))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in FILTERS.split(", ")])

        left = changes.select("k1", "k2", "before", "after", shard_of(shards)).groupBy("shard")
        return left.cogroup(self.filters().groupBy("shard")).applyInPandas(run, FILTERS)

    # writing -------------------------------------------------------------------------------------------------------

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/v{version}"

    def _write(self, df: DataFrame, kind: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(kind, version))
        return self.spark.read.schema(df.schema).parquet(self._path(kind, version))

    def _commit(self, counts: DataFrame, changes: DataFrame, version: int, shards: int) -> None:
        """Write the filters of a version whose exact rows ``counts`` are written, and make it visible."""
        commits = self._commits()
        kept = commits[-1].shards if commits else 0
        if kept != shards:
            # the first version, or more shards than before: all filters from the exact table
            everything = counts
            if commits:
                everything = self.counts().join(counts, LINE, "left_anti").unionByName(counts.select(*LINE, "n_docs", "owner"))
            self._write(self._build(everything.filter("n_docs > 0"), shards, version), "filters", version)
        else:
            made = self._write(self._change(changes, shards, version), "changed", version)
            full = [r.shard for r in made.filter("slots IS NULL").select("shard").distinct().collect()]
            if full:
                latest = self.counts().join(counts, LINE, "left_anti").unionByName(counts.select(*LINE, "n_docs", "owner"))
                made = made.filter(~F.col("shard").isin(full)).unionByName(self._build(latest.filter("n_docs > 0"), shards, version, full))
            self._write(made, "filters", version)
        self.spark.range(1).select(F.lit(version).alias("version"), F.lit(shards).cast("long").alias("shards")).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def insert(self, refs: DataFrame) -> DataFrame:
        """Add documents, given by ``keyed``; returns their references as written."""
        commits = self._commits()
        version = commits[-1].version + 1 if commits else 0
        refs = self._write(refs, "refs", version)
        lines = refs.groupBy(LINE).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        lines = self._write(lines, "inserted", version)
        distinct = lines.count()
        shards = commits[-1].shards if commits else 8
        held = distinct + (self.filters().filter("kind = 'seen'").agg(F.sum("held")).first()[0] or 0)
        while shards * SHARD_LINES < held:
            shards *= 2
        old = self.spark.createDataFrame([], "k1 bigint, k2 bigint, n_docs bigint, owner bigint")
        if commits:
            maybe = self._probe(lines, "seen", commits[-1].shards)
            old = self.counts().join(maybe.select(*LINE), LINE, "left_semi")
        merged = lines.join(old, LINE, "left").select(
            *LINE, F.coalesce("n_docs", F.lit(0)).alias("before"), (F.coalesce("n_docs", F.lit(0)) + F.col("n")).alias("n_docs"),
            F.greatest("owner", "top").alias("owner"), F.lit(version).cast("long").alias("version"),
        )
        made = self._write(merged, "counts", version)
        self._commit(made, made.select(*LINE, "before", F.col("n_docs").alias("after")), version, shards)
        return refs

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take the documents with these ids out again."""
        commits = self._commits()
        if not commits:
            return
        version = commits[-1].version + 1
        held = self.refs()
        gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
        left = self.refs()
        gone = self._write(gone, "gone", version)
        lines = held.join(gone, "doc_id", "left_semi").groupBy(LINE).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        lines = self._write(lines, "deleted", version)
        old = self.counts().join(lines, LINE)
        orphans = old.filter("n_docs > n AND owner = top").select(*LINE)
        heirs = left.join(gone, "doc_id", "left_anti").join(orphans, LINE, "left_semi").groupBy(LINE).agg(F.max("doc_id").alias("heir"))
        moved = (F.col("n_docs") > F.col("n")) & (F.col("owner") == F.col("top"))
        merged = old.join(heirs, LINE, "left").select(
            *LINE, F.col("n_docs").alias("before"), (F.col("n_docs") - F.col("n")).alias("n_docs"),
            F.when(moved, F.col("heir")).otherwise(F.col("owner")).alias("owner"), F.lit(version).cast("long").alias("version"),
        )
        made = self._write(merged, "counts", version)
        self._commit(made, made.select(*LINE, "before", F.col("n_docs").alias("after")), version, commits[-1].shards)

    # use -----------------------------------------------------------------------------------------------------------

    def dropped(self, refs: DataFrame) -> DataFrame:
        """doc_id, text_hash and the keys (arrays k1, k2) that each document of ``refs`` loses."""
        commits = self._commits()
        shards = commits[-1].shards if commits else 1
        lines = refs.groupBy(LINE).agg(F.count("*").alias("n"))
        maybe = self._probe(lines, "repeated", shards).select(*LINE)
        repeated = self.counts().filter(F.col("n_docs") >= self.min_docs).join(maybe, LINE, "left_semi")
        path = new_folder(self.spark, "repeated-lines")
        repeated.write.parquet(path)
        repeated = self.spark.read.schema(repeated.schema).parquet(path)
        total = repeated.agg(F.sum("n_docs")).first()[0] or 0
        heavy = F.col("n_docs") > HEAVY * total
        lost = ~F.col("doc_id").eqNullSafe(F.col("owner"))
        # one column says of a line whether it is heavy, so that each reference goes one way
        some = refs.join(F.broadcast(repeated.filter(heavy).select(*LINE, "owner", F.lit(True).alias("heavy"))), LINE, "left")
        few = some.filter("heavy IS NULL").drop("owner", "heavy").join(repeated.filter(~heavy).select(*LINE, "owner"), LINE)
        hits = some.filter("heavy").drop("heavy").filter(lost).unionByName(few.filter(lost))
        return hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("k1", "k2")).alias("keys")).select(
            "doc_id", "text_hash", F.col("keys.k1").alias("k1"), F.col("keys.k2").alias("k2")
        )


def rewrite(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """``docs`` with the lines in ``dropped`` taken out of the text, and two more columns: n_lines, n_dropped."""
    names = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"),
    )
    same = rows["id"].eqNullSafe(dropped["doc_id"]) & (rows["hash"] == dropped["text_hash"])
    met = rows.join(dropped, same, "left").select("row", "text", "k1", "k2")
    schema = StructType([met.schema["row"], StructField("text", StringType())]).add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, k1, k2 in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2), part.column(3), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if k1.is_valid:
                    both = np.stack([k.values.to_numpy(zero_copy_only=False) for k in (k1, k2)], axis=1)
                    lost = {row.tobytes() for row in both}
                    lines = [line for line in lines if line_key(line, min_chars) not in lost]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(text)
            columns = [part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_lines", "n_dropped"])

    done = met.mapInArrow(run, schema)
    return done.select(*[F.col(f"row.`{c}`") if c != text_col else F.col("text").alias(c) for c in docs.columns], "n_lines", "n_dropped")


def dedup(docs: DataFrame, folder: str | None = None, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``docs`` entered into a new index at ``folder``, without the lines that at least ``min_docs`` of them hold, except
    in the document of the largest id; n_lines and n_dropped added."""
    spark = docs.sparkSession
    index = LineIndex(spark, folder or new_folder(spark, "line-index"), min_docs)
    refs = index.insert(keyed(docs, id_col, text_col, min_chars))
    return rewrite(docs, index.dropped(refs), id_col, text_col, min_chars)
