"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words: occurrences times the mean inverse document frequency of
the words. (A shingle's own document frequency would say little: nearly all occur once, and those of a copied text
would lose weight because the text was copied.) Consistent weighted sampling draws 50 shingles of each set, such that
two sets draw the same one with the probability of their weighted Jaccard similarity; runs of 5 samples are the bands.
Documents that share a band are verified by their true weighted Jaccard similarity, and links make classes.

No bucket is expanded into rows for its pairs. Equal texts are one node. The texts of a bucket meet in a task, which
compares their sketches and verifies pairs from the most similar sketches on; a pair whose members are already in one class
is not verified, as its link would not change it. A task gives back only which classes became one. Buckets are taken in
turns, the first band first; in later turns those whose members are in one class by then do not take part. A bucket of more
than ``TILE`` members is dealt over several tasks, and the members that are in most and largest buckets are sent to all of
them: copies of one text are most like that text. Where this leaves members in different classes, every two parts of
the bucket meet in a further task. Pairs whose sketches agree in fewer than half of the samples are not verified: two texts of similarity 0.8
do so once in some 10^6 pairs.

Document frequencies are counted for each word, over all documents. Those of the 2^20 most frequent words are sent
around; of the others those in two documents or more stay a table and are joined to the texts that hold them. A word
that is neither sent nor joined is in one document. So that such words are not shuffled, a bitmap of 16 MB tells the
workers which words may be in the table; where it errs, the join finds nothing.

Edge cases: a null text counts as empty; texts without words are equal to each other; a text of fewer than five words
is one shingle; a null id takes part, and the class id is the smallest id of the class (null if it has none); rows
that repeat an id or a text share its class; very long texts are sampled whole; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import SPACES, at_work, stage

SHINGLE = 5
THRESHOLD = 0.8
#: Ten bands of five: two texts of similarity 0.8 share one in 98 of 100 cases, of 0.9 in all but one of 7,500, of 0.3 in
#: 2 of 100.
SAMPLES, BAND = 50, 5
#: Words whose document frequencies are sent to every worker (16 MB); a bound on memory, not on the words counted.
SENT_WORDS = 1 << 20
#: Bits of the bitmap of the other words in two documents or more, in pieces as Spark's bitmap functions make them.
BITS, PIECE_BITS = 1 << 27, 1 << 15
#: Rows of the tables of random numbers; a shingle takes the row of its hash.
DRAWS = 1 << 16
#: Shingles sampled at a time; few enough for their numbers to stay in the processor's cache.
ROWS = 512
#: The first and the last band of each turn.
TURNS = [(0, 0), (1, 3), (4, SAMPLES // BAND - 1)]
#: Members of a bucket, and their characters, that meet in one task; bounds on its memory, not on the bucket.
TILE, TILE_CHARS = 1024, 8 << 20
#: So few are compared in all samples at once.
FEW = 64
#: Members that are sent to all parts of a bucket.
HUBS = 16
#: Samples that must agree before the sets of a pair are fetched.
AGREE = 25
MIX = np.uint64(0x9E3779B97F4A7C15)


def node(text: Column) -> Column:
    """The identity of a text: its words."""
    return F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "++", " ")))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of 64 bits of each word, the same in all workers."""
    return hash_array(np.array(words, object), categorize=False) if words else np.array([], np.uint64)


_draws: list[np.ndarray] = []


def forget() -> None:
    _draws.clear()


def draws() -> list[np.ndarray]:
    """Tables of r, 1/r, beta and ln c; made once by a worker, the same in all."""
    at_work("minhash", forget)
    if not _draws:
        random = np.random.Generator(np.random.Philox(2010))
        shape = (DRAWS, SAMPLES)
        r = random.standard_gamma(2.0, shape, np.float32)
        log_c = np.log(random.standard_gamma(2.0, shape, np.float32))
        beta = random.random(shape, np.float32)
        _draws.extend([r, 1 / r, beta, log_c - r])
    return _draws


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Frequencies:
    """Documents, the sorted hashes of the most frequent words with their document frequencies, and, if further words are
    in two documents or more, node, words in order and counts of all texts that hold some. Other words are in one."""

    documents: int
    words: np.ndarray
    counts: np.ndarray
    others: DataFrame | None = None

    def sent(self) -> Frequencies:
        return Frequencies(self.documents, self.words, self.counts)

    def __post_init__(self) -> None:
        # where the words with the same first bits begin; about one word has the same, so a look-up takes a step or two
        bits = max(1, len(self.words).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands among those sent around, and whether it is one of them."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        last = len(self.words) - 1
        at = np.minimum(self.begins[(hashes >> self.shift).astype(np.intp)], last)
        further = np.flatnonzero(self.words[at] < hashes)
        while len(further):
            further = further[at[further] < last]
            at[further] += 1
            further = further[self.words[at[further]] < hashes[further]]
        return at, self.words[at] == hashes

    def idf(self, hashes: np.ndarray, others: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Inverse document frequency of each word of a text; ``others`` has the words that were not sent."""
        at, sent = self.known(hashes)
        counts = np.where(sent, self.counts[at] if len(self.counts) else 0, 1)
        if others is not None and not sent.all():
            words, n = others
            rest = hashes[~sent].view(np.int64)
            where = np.minimum(np.searchsorted(words, rest), len(words) - 1)
            counts[~sent] = np.where(words[where] == rest, n[where], 1)
        return (1 + np.log((1 + self.documents) / (1 + counts))).astype(np.float32)


def weighted_shingles(text: str | None, idf: Frequencies, others: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles in order, and their weights."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.array([], np.uint64), np.array([], np.float32)
    hashes = word_hashes(words)
    value = idf.idf(hashes, others)
    n = max(1, len(words) - SHINGLE + 1)
    width = min(SHINGLE, len(words))
    shingles, mean = np.zeros(n, np.uint64), np.zeros(n)
    for at in range(width):
        shingles = mixed(shingles * MIX + hashes[at : at + n])
        mean += value[at : at + n]
    distinct, first, counts = np.unique(shingles, return_index=True, return_counts=True)
    return distinct, (counts * mean[first] / width).astype(np.float32)


def sketch(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One number for each sample: the drawn shingle and its level."""
    r, inverse, beta, shifted = draws()
    best = np.full(SAMPLES, np.inf, np.float32)
    found = np.zeros(SAMPLES, np.uint64)
    logs = np.log(weights)[:, None]
    columns = np.arange(SAMPLES)
    for at in range(0, len(shingles), ROWS):
        part = shingles[at : at + ROWS]
        rows = (part % np.uint64(DRAWS)).astype(np.intp)
        # take copies whole rows, which indexing does number by number
        level = inverse.take(rows, 0)
        level *= logs[at : at + ROWS]
        b = beta.take(rows, 0)
        level += b
        np.floor(level, out=level)
        cost = level - b
        cost *= r.take(rows, 0)
        np.subtract(shifted.take(rows, 0), cost, out=cost)
        first = cost.argmin(axis=0)
        least = cost[first, columns]
        better = least < best
        best[better] = least[better]
        drawn = mixed(part[first] + level[first, columns].astype(np.int64).astype(np.uint64) * MIX)
        found[better] = drawn[better]
    return (found >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of weighted shingles."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return least / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - least)


def document_frequencies(docs: DataFrame, text_col: str) -> Frequencies:
    """The exact document frequencies of all words."""

    def distinct(text: str | None) -> np.ndarray:
        return word_hashes(list(set((text or "").encode("utf-8", "replace").split())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            words = [distinct(text) for text in part.column(0).to_pylist()]
            found, n = np.unique(np.concatenate([*words, np.array([], np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "n"])

    counted = docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # most words of a corpus are in one document; these need no table
    counted = stage(counted.filter("n > 1"), "word-counts")
    top = counted.orderBy(F.desc("n"), "word").limit(SENT_WORDS).toArrow()  # SENT_WORDS rows at most
    words, counts = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(words)
    frequencies = Frequencies(docs.count(), words[order], counts[order])
    if counted.count() <= SENT_WORDS:
        return frequencies
    context = docs.sparkSession.sparkContext
    shared, bitmap = context.broadcast(frequencies), context.broadcast(maybe_shared(counted))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [distinct(text) for text in part.column(1).to_pylist()]
            found = [w[~shared.value.known(w)[1] & holds(bitmap.value, w)] for w in found]
            nodes = pa.array(part.column(0)).take(pa.array(np.repeat(np.arange(len(found)), [len(w) for w in found])))
            joined = np.concatenate([*found, np.array([], np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([nodes, pa.array(joined)], ["node", "word"])

    # a word that was not sent is in few texts; equal texts are one node
    held = docs.select(node(F.col(text_col)).alias("node"), text_col).mapInArrow(rare, "node string, word long").distinct()
    lists = held.join(counted, "word").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("found"))
    lists = lists.select("node", F.col("found.word").alias("words"), F.col("found.n").alias("counts"))
    frequencies.others = stage(lists, "rare-words")
    return frequencies


def maybe_shared(counted: DataFrame) -> np.ndarray:
    """A bitmap (as bytes) with the bit of every word of ``counted``; BITS / 8 bytes, whatever the corpus."""
    bit = F.pmod("word", F.lit(BITS))
    pieces = counted.select((bit / PIECE_BITS).cast("int").alias("piece"), (bit % PIECE_BITS).alias("at"))
    pieces = pieces.groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()  # BITS / PIECE_BITS rows
    bits = np.zeros((BITS // PIECE_BITS, PIECE_BITS // 8), np.uint8)
    for piece, found in zip(pieces.column("piece").to_pylist(), pieces.column("bits").to_pylist(), strict=True):
        bits[piece] = np.frombuffer(found, np.uint8)
    return bits.ravel()


def holds(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which words have their bit in the bitmap; all that were put there do."""
    at = words & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def with_rare_words(rows: DataFrame, idf: Frequencies) -> DataFrame:
    """``rows``, which have a node, with the words and counts that were not sent to the workers."""
    if idf.others is None:
        return rows.withColumns({c: F.lit(None).cast("array<long>") for c in ("words", "counts")})
    return rows.join(idf.others, "node", "left").select(*rows.columns, "words", "counts")


def _others(part: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray] | None]:
    lists = part.column("words"), part.column("counts")
    (words, starts), (counts, _) = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in lists]
    known = lists[0].is_valid().to_pylist()
    # both lists of a row have one length; a batch's lists begin where its offsets say
    shift = lists[1].offsets[0].as_py() - starts[0] if len(known) else 0
    spans = zip(known, starts[:-1], starts[1:], strict=True)
    return [(words[a:b], counts[a + shift : b + shift]) if some else None for some, a, b in spans]


def sketches(docs: DataFrame, idf: Frequencies, text_col: str) -> DataFrame:
    """node, text, the words and counts that were not sent, and the sketch (none for a text without words); one row of
    each node."""
    shared = docs.sparkSession.sparkContext.broadcast(idf.sent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for text, others in zip(part.column(1), _others(part), strict=True):
                shingles, weights = weighted_shingles(text.as_py(), shared.value, others)
                rows.append(sketch(shingles, weights) if len(shingles) else None)
            columns = [part.column(c) for c in ("node", "text", "words", "counts")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.int32()))], ["node", "text", "words", "counts", "sketch"])

    rows = docs.select(node(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    one = F.row_number().over(Window.partitionBy("node").orderBy(F.lit(0)))
    first = rows.withColumn("rank", one).filter("rank = 1").select("node", "text")
    return with_rare_words(first, idf).mapInArrow(run, "node string, text string, words array<long>, counts array<long>, sketch array<int>")


def band_members(texts: DataFrame) -> DataFrame:
    """(band, key, node, chars, n) of the nodes that share a band with others; ``n`` nodes share this one."""
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLES // BAND - 1)),
        lambda b: F.struct(b.alias("band"), F.xxhash64(b, *[F.get("sketch", b * BAND + i) for i in range(BAND)]).alias("key")),
    )
    keyed = texts.filter("sketch IS NOT NULL").select("node", F.length("text").alias("chars"), F.explode(bands).alias("at"))
    keyed = keyed.select("at.band", "at.key", "node", "chars")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(shared, "key").select("band", "key", "node", "chars", "n")


def maybe_members(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``texts`` without most of those whose node is not among ``members``, by a bitmap, so that no text is shuffled for
    it; all members stay."""
    names = texts.columns
    bits = texts.sparkSession.sparkContext.broadcast(maybe_shared(members.select(F.xxhash64("node").alias("word"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            some = holds(bits.value, part.column("hash").to_numpy().view(np.uint64))
            yield part.filter(pa.array(some)).select(names)

    return texts.withColumn("hash", F.xxhash64("node")).mapInArrow(run, texts.schema)


def joined_labels(tiles: DataFrame, idf: Frequencies, threshold: float) -> DataFrame:
    """``tiles`` (tile, part, label, node, text, words, counts, sketch) to links (a, b) between labels: rows of a tile are
    compared with each other, unless they are of the same part (null is the same as none)."""
    shared = tiles.sparkSession.sparkContext.broadcast(idf.sent())
    columns = ["tile", "text", "words", "counts", "part", "label", "sketch"]

    def compare(rows: pa.RecordBatch) -> Iterator[tuple[str, str]]:
        """The links within the rows of one tile."""
        names = rows.column("label").to_pylist()
        parent = {name: name for name in names}
        if len(parent) == 1:
            return
        sketched = rows.column("sketch").flatten().to_numpy().reshape(len(names), SAMPLES)
        parts = rows.column("part").to_numpy(zero_copy_only=False)
        others, texts, sets = _others(rows), rows.column("text"), {}

        def root(name: str) -> str:
            while parent[name] != name:
                parent[name] = name = parent[parent[name]]
            return name

        def weighted(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in sets:
                sets[i] = weighted_shingles(texts[i].as_py(), shared.value, others[i])
            return sets[i]

        if len(names) <= FEW:
            agree = (sketched[:, None] == sketched).sum(2, dtype=np.uint8)
        else:
            agree = np.zeros((len(names), len(names)), np.uint8)
            for sample in np.ascontiguousarray(sketched.T):
                agree += sample[:, None] == sample
        first, second = np.nonzero(np.triu(agree >= AGREE, 1))
        apart = ~(parts[first] == parts[second])  # null parts are not equal
        first, second = first[apart], second[apart]
        classes = len(parent)
        for at in np.argsort(-agree[first, second].astype(int), kind="stable").tolist():
            i, j = int(first[at]), int(second[at])
            a, b = root(names[i]), root(names[j])
            if a != b and similarity(weighted(i), weighted(j)) >= threshold:
                parent[max(a, b)] = min(a, b)
                classes -= 1
                if classes == 1:
                    break
        yield from ((name, root(name)) for name in parent if root(name) != name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last tile so far, which may go on in the next batch
        for part in batches:
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            tile = part.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist()]
            yield linked(part.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))
            held = part.slice(cuts[-1])
        if held is not None:
            yield linked([held])

    def linked(parts) -> pa.RecordBatch:
        found = [link for part in parts if len(part) > 1 for link in compare(part)]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["a", "b"])

    # a number of its own, so that Spark does not put costly tiles of few bytes into one task
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.select(*columns).repartition(tasks, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have links: the label is the least node of the component."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    both = stage(both.filter("a != b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        # a label is a node and has a label itself
        onward = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = step.join(onward, step["next"] == onward["via"]).select("node", "label", F.least("next", "further").alias("next"))
        step = stage(step, "labels")
        changed = step.filter("label != next").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after links between labels."""
    moved = components(links).select(F.col("node").alias("label"), F.col("label").alias("onto"))
    return stage(labels.join(moved, "label", "left").withColumn("label", F.coalesce("onto", "label")).drop("onto"), "labels")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that are in different classes, with label, weight and the parts (one or more) that their
    bucket is dealt over."""
    named = members.join(labels, "node")
    sizes = named.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("rows"), F.sum("chars").alias("size")
    )
    parts = F.ceil(F.greatest(F.col("rows") / TILE, F.col("size") / TILE_CHARS)).alias("parts")
    return named.join(sizes.filter("least != most").select("key", parts), "key").select("key", "node", "label", "weight", "parts")


def part_of() -> Column:
    return F.pmod(F.xxhash64("node"), F.col("parts"))


def tiles_of_buckets(opened: DataFrame) -> DataFrame:
    """A tile for each bucket, or for each part of a large one; its hubs are in all its tiles."""
    none = F.lit(None).cast("long").alias("part")
    small = opened.filter("parts = 1").select(F.xxhash64("key", F.lit(0)).alias("tile"), none, "label", "node")
    heaviest = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    large = opened.filter("parts > 1").withColumn("rank", F.row_number().over(heaviest))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    large = large.withColumn("in", F.explode(F.when(F.col("rank") <= HUBS, every).otherwise(F.array(part_of()))))
    return small.union(large.select(F.xxhash64("key", "in").alias("tile"), none, "label", "node"))


def tiles_of_parts(opened: DataFrame) -> DataFrame:
    """A tile for every two parts of a large bucket."""
    large = opened.filter("parts > 1").withColumn("part", part_of())
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("`with` != part")
    tile = F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))
    return large.select(tile.alias("tile"), "part", "label", "node")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size (rows) and node (the identity of its words)."""
    return labelled_classes(docs, id_col, text_col, threshold).drop("label")


def labelled_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """``near_classes`` with the label of the class, which no other class has."""
    idf = document_frequencies(docs, text_col)
    texts = stage(sketches(docs, idf, text_col), "sketches")
    members = stage(band_members(texts), "band-members")
    labels = members.groupBy("node").agg(F.sum("n").alias("weight")).withColumn("label", F.col("node"))
    labels = stage(labels, "labels")
    texts = stage(maybe_members(texts, labels), "member-texts")

    def compared(labels: DataFrame, tiles: DataFrame) -> DataFrame:
        tiles = stage(tiles, "tiles")
        if not tiles.limit(1).count():
            return labels
        # one plan for all sizes: few tiles are not sent around either
        links = stage(joined_labels(tiles.join(texts.hint("merge"), "node"), idf, threshold), "label-links")
        return merged(labels, links) if links.limit(1).count() else labels

    for begin, end in TURNS:
        turn = members.filter(F.col("band").between(begin, end))
        labels = compared(labels, tiles_of_buckets(open_members(turn, labels)))
    # parts of large buckets have met their hubs only
    labels = compared(labels, tiles_of_parts(open_members(members, labels)))
    rows = docs.select(F.col(id_col).alias("id"), node(F.col(text_col)).alias("node"))
    labelled = rows.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return labelled.join(classes, "label").select(F.col("id").alias(id_col), "class_id", "class_size", "node", "label")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id, all columns as they are."""
    classes = labelled_classes(docs, id_col, text_col, **options)
    # rows of a class share class_id, but so may classes without ids or with the same id: the label tells them apart
    first = Window.partitionBy("label").orderBy(F.col(id_col).asc_nulls_last(), "node")
    stay = classes.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    stay = stay.select(F.col(id_col).alias("_id"), F.col("node").alias("_node"))
    marked = docs.withColumn("_words", node(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_node"))
    # rows that repeat the id and the words are one document
    one = F.row_number().over(Window.partitionBy(id_col, "_words").orderBy(F.lit(0)))
    kept = marked.join(stay, same, "left_semi").withColumn("_rank", one)
    return kept.filter("_rank = 1").drop("_words", "_rank")
