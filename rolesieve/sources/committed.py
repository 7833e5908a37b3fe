"""Tables that grow by commits: rows with a unique key, snapshots, filters for lookups, several writers at once.

A table's folder holds segments (Parquet, never changed), for each segment a table of Bloom filters of its keys, and a log
of manifests. A manifest lists the segments of one version with their counts of rows; writing it is the commit. Whatever
a writer that was lost has left is in no manifest and thus not read.

* ``append`` writes the rows whose key the table lacks as a segment and commits it. If another writer was faster, only
  what that one added is looked at, rows it has as well are taken out, and the commit is tried again: every key is in
  the table once. A batch that names itself is appended once.
* ``compact`` rewrites all segments as one, sorted and in folders by the first characters of the key; what others append
  meanwhile stays. ``vacuum`` removes files that no manifest needs.
* ``known`` looks keys up: filters tell which folders of which segments can hold one, only those are read, and the
  answer from them is exact.

Parquet files that lie in the folder itself, from before the first commit, belong to the table as a segment without
filter, until they are compacted.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rolesieve.functions.bits import BITS, bit_is_set
from rolesieve.functions.text import strip
from rolesieve.sources import files
from rolesieve.sources.tables import read_parquet_or_empty

#: A filter block is one bitmap of 32,768 bits for about this many keys: some 12 bits a key.
BLOCK_KEYS = 2700
#: Bits that a key sets in its block.
PROBES = 7
#: Rows of a compacted folder.
FOLDER_ROWS = 1 << 21
#: Folders of a segment at most; a manifest holds a count for each.
MOST_FOLDERS = 4096
#: Batches whose names a manifest keeps.
BATCHES = 1000
LOOSE = "."


@dataclass(frozen=True)
class Segment:
    """``folders``: rows by key prefix of a compacted segment. ``rows`` is None where nobody has counted them."""

    name: str
    rows: int | None
    blocks: int = 0
    prefix: int = 0
    folders: dict[str, int] | None = None


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    version: int
    segments: tuple[Segment, ...]
    batches: tuple[str, ...] = ()

    @property
    def rows(self) -> int | None:
        """All rows, None if a segment is not counted."""
        counts = [s.rows for s in self.segments]
        return None if None in counts else sum(counts)

    def to_json(self) -> str:
        return json.dumps({"segments": [vars(s) for s in self.segments], "batches": self.batches})


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _positions(key: Column) -> Column:
    """The bits of a key in its block."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)) for i in range(1, PROBES + 1)])


def _holds(bits: Column, key: Column) -> Column:
    """All bits of ``key`` are set in the bitmap of its block."""
    return F.forall(_positions(key), lambda position: bit_is_set(bits, position))


def _bitmap(keys: pa.Table) -> pa.Table:
    """The filter of one block, as ``bitmap_construct_agg`` makes it, of the rows (block, positions) of its keys."""
    bits = np.zeros(BITS, np.uint8)
    bits[keys.column("positions").combine_chunks().flatten().to_numpy(zero_copy_only=False)] = 1
    return pa.table({"block": keys.column("block")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


class CommittedTable:
    """The table at ``path`` with columns ``schema`` (DDL) and unique strings in column ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, folder_rows: int = FOLDER_ROWS):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.folder_rows = folder_rows
        self.columns = [F.col(f"`{n}`") for n in spark.createDataFrame([], schema).columns]

    # versions --------------------------------------------------------------------------------------------------------

    def _version(self) -> int:
        names = files.list_files(self.spark, f"{self.path}/_log")
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def snapshot(self) -> Snapshot:
        """The latest version; version 0 is what lay in the folder before the first commit."""
        version = self._version()
        if version:
            told = json.loads(files.read_text(self.spark, self._manifest(version)))
            return Snapshot(version, tuple(Segment(**s) for s in told["segments"]), tuple(told["batches"]))
        loose = any(not n.startswith(("_", ".")) for n in files.list_files(self.spark, self.path))
        return Snapshot(0, (Segment(LOOSE, None),) if loose else ())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_log/{version:012d}.json"

    def _commit(self, made: Snapshot) -> bool:
        # a version that was taken long ago may have lost its file to vacuum
        return self._version() < made.version and files.create_once(self.spark, self._manifest(made.version), made.to_json())

    def _folder(self, segment: Segment) -> str:
        return self.path if segment.name == LOOSE else f"{self.path}/_segments/{segment.name}"

    # reading ---------------------------------------------------------------------------------------------------------

    def _rows(self, segment: Segment, prefixes: list[str] | None = None) -> DataFrame:
        if not segment.prefix:
            return read_parquet_or_empty(self.spark, self._folder(segment), self.schema).select(self.columns)
        rows = self.spark.read.schema(f"{self.schema}, _prefix string").parquet(self._folder(segment))
        if prefixes is not None:
            rows = rows.filter(F.col("_prefix").isin(prefixes))
        return rows.select(self.columns)

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """All rows of the latest or the given version."""
        rows = self.spark.createDataFrame([], self.schema)
        segments = (snapshot or self.snapshot()).segments
        for at, segment in enumerate(segments):
            rows = rows.unionByName(self._rows(segment)) if at else self._rows(segment)
        return rows

    def count(self) -> int:
        """The number of rows: from the manifest, unless a segment was never counted."""
        snapshot = self.snapshot()
        uncounted = [s for s in snapshot.segments if s.rows is None]
        rows = sum(s.rows for s in snapshot.segments if s.rows is not None)
        # rows from before the first commit may repeat a key
        return rows + sum(self._keys_of(s).distinct().count() for s in uncounted)

    def _keys_of(self, segment: Segment, prefixes: list[str] | None = None) -> DataFrame:
        return self._rows(segment, prefixes).select(self._key().alias("key")).filter(F.col("key") != "")

    def _key(self) -> Column:
        return strip(F.col(f"`{self.key}`"))

    def candidates(self, keys: DataFrame, snapshot: Snapshot) -> dict[str, list[str]]:
        """The segments, and in each the key prefixes, that may hold one of ``keys`` (a column ``key``)."""
        filtered = [s for s in snapshot.segments if s.blocks]
        if not filtered:
            return {}
        filters = None
        for s in filtered:
            part = self.spark.read.schema("block bigint, bits binary").parquet(f"{self.path}/_filters/{s.name}")
            part = part.withColumn("segment", F.lit(s.name))
            filters = part if filters is None else filters.unionByName(part)
        named = F.array(*[F.struct(F.lit(s.name).alias("segment"), F.lit(s.blocks).cast("long").alias("blocks"),
                                   F.lit(s.prefix).alias("prefix")) for s in filtered])
        asked = keys.select("key", F.explode(named).alias("s"))
        asked = asked.select("key", "s.segment", _block(F.col("key"), F.col("s.blocks")).alias("block"),
                             F.substring("key", F.lit(1), F.col("s.prefix")).alias("prefix"))
        maybe = asked.join(filters, ["segment", "block"]).filter(_holds(F.col("bits"), F.col("key")))
        # at most MOST_FOLDERS rows a segment
        found: dict[str, list[str]] = {}
        for r in maybe.select("segment", "prefix").distinct().collect():
            found.setdefault(r.segment, []).append(r.prefix)
        return found

    def known(self, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """The part of ``keys`` (a staged table with a column ``key``) that the table holds.

        Segments and folders that hold none of them by their filters are not read; the others are scanned for the keys
        if these are small, or shuffled with them. A segment of no more rows than there are keys is read as it is: to
        bring every key to its filter, by a shuffle where the filters are large, costs more than its rows.
        """
        snapshot = snapshot or self.snapshot()
        keys = keys.select("key")
        asked = keys.count() if any(s.blocks for s in snapshot.segments) else 0
        whole = {s.name for s in snapshot.segments if not s.blocks or s.rows <= asked}
        found = self.candidates(keys, replace(snapshot, segments=tuple(s for s in snapshot.segments if s.name not in whole)))
        known = None
        for segment in snapshot.segments:
            if segment.name not in whole and segment.name not in found:
                continue
            in_part = segment.prefix and segment.name not in whole
            held = self._keys_of(segment, sorted(found[segment.name]) if in_part else None)
            held = held.join(keys, "key", "left_semi")
            known = held if known is None else known.unionByName(held)
        return keys.limit(0) if known is None else known

    # writing ---------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, prefix: int = 0) -> Segment:
        """A new segment with its filters, in no manifest yet."""
        name = uuid.uuid4().hex
        folder, counted = f"{self.path}/_segments/{name}", Observation()
        rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
        if prefix:
            split = rows.withColumn("_prefix", F.substring(self._key(), 1, prefix))
            split = split.repartition("_prefix").sortWithinPartitions("_prefix", f"`{self.key}`")
            split.write.partitionBy("_prefix").parquet(folder)
        else:
            rows.write.parquet(folder)
        n = counted.get["rows"]
        blocks = 1
        while blocks * BLOCK_KEYS < n:
            blocks *= 2
        segment = Segment(name, n, blocks, prefix)
        if prefix:
            parts = self.spark.read.schema(f"{self.schema}, _prefix string").parquet(folder).groupBy("_prefix").count()
            segment = replace(segment, folders={r["_prefix"]: r["count"] for r in parts.collect()})
        keys = self._keys_of(segment)
        # a block has some BLOCK_KEYS keys at most, however many there are
        bits = keys.select(_block(F.col("key"), F.lit(blocks).cast("long")).alias("block"), _positions(F.col("key")).alias("positions"))
        bits.groupBy("block").applyInArrow(_bitmap, "block long, bits binary").write.parquet(f"{self.path}/_filters/{name}")
        return segment

    def _drop(self, segment: Segment) -> None:
        for kind in ("_segments", "_filters"):
            files.delete(self.spark, f"{self.path}/{kind}/{segment.name}")

    def append(self, rows: DataFrame, batch: str | None = None, absent_from: Snapshot | None = None, staged: bool = False) -> int:
        """Append the rows whose key the table lacks; returns how many. Keys must not repeat within ``rows``, which is
        computed once, or read more than once if it is ``staged``. ``absent_from``: a version that is known to have none
        of them."""
        base = self.snapshot() if absent_from is None else absent_from
        if batch is not None and batch in base.batches:
            return 0
        rows, landed = rows.select(self.columns), None
        if absent_from is None and base.segments:
            if not staged:
                # like a segment that is in no manifest yet
                landed = Segment(uuid.uuid4().hex, None)
                rows.write.parquet(self._folder(landed))
                rows = self._rows(landed)
            named = rows.withColumn("key", self._key())
            rows = named.join(self.known(named, base), "key", "left_anti").select(self.columns)
        segment = self._write(rows)
        if landed is not None:
            self._drop(landed)
        while True:
            if not segment.rows and batch is None:
                self._drop(segment)
                return 0
            batches = base.batches if batch is None else (*base.batches, batch)[-BATCHES:]
            kept = (segment,) if segment.rows else ()
            if self._commit(Snapshot(base.version + 1, base.segments + kept, batches)):
                if not segment.rows:
                    self._drop(segment)
                return segment.rows
            newer = self.snapshot()
            if batch is not None and batch in newer.batches:
                self._drop(segment)
                return 0
            segment = self._without(segment, Snapshot(newer.version, tuple(s for s in newer.segments if s not in base.segments)))
            base = newer

    def _without(self, segment: Segment, added: Snapshot) -> Segment:
        """``segment`` again if ``added`` holds none of its keys, else a new one without those."""
        keys = self._keys_of(segment)
        clash = self.known(keys, added)
        if clash.isEmpty():
            return segment
        own = self._rows(segment).withColumn("key", self._key())
        rest = self._write(own.join(clash, "key", "left_anti").select(self.columns))
        self._drop(segment)
        return rest

    def compact(self) -> Snapshot:
        """Rewrite all segments as one, sorted by key; returns the version that has it. Gives up, changing nothing, if
        another compaction was faster."""
        base = self.snapshot()
        if len(base.segments) <= 1 and all(s.folders is not None for s in base.segments):
            return base
        rows = self.read(base)
        if any(s.name == LOOSE for s in base.segments):
            # these may repeat a key; rows without one stay
            blank = F.coalesce(self._key(), F.lit("")) == ""
            rows = rows.filter(~blank).dropDuplicates([self.key]).unionByName(rows.filter(blank))
        estimate = base.rows if base.rows is not None else rows.count()
        prefix = 1
        while 16**prefix * self.folder_rows < estimate and 16 ** (prefix + 1) <= MOST_FOLDERS:
            prefix += 1
        made = self._write(rows, prefix)
        newer = base
        while True:
            later = tuple(s for s in newer.segments if s not in base.segments)
            if self._commit(Snapshot(newer.version + 1, (made, *later), newer.batches)):
                return self.snapshot()
            newer = self.snapshot()
            if not set(s.name for s in base.segments) <= set(s.name for s in newer.segments):
                self._drop(made)
                return newer

    def vacuum(self, older_than: float = 86400.0) -> int:
        """Remove segments, filters and manifests that the latest version does not need and that are older than this many
        seconds (a writer may still be at work on younger ones); returns how many. Loose files stay where they are."""
        snapshot, before, removed = self.snapshot(), 1000 * (time.time() - older_than), 0
        needed = {s.name for s in snapshot.segments}
        for kind in ("_segments", "_filters", "_log"):
            for name, changed in files.list_files(self.spark, f"{self.path}/{kind}").items():
                current = name in needed or name == self._manifest(snapshot.version).rsplit("/", 1)[1]
                if not current and changed <= before:
                    files.delete(self.spark, f"{self.path}/{kind}/{name}")
                    removed += 1
        return removed
