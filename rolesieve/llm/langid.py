"""Language identification by segmentation-marginalised unigrams.

The pieces of a public vocabulary have a probability per language. A word's probability is the sum over all ways to
cut it into pieces, which the forward algorithm gives; a text's is the product over its words (runs of letters, in
lower case). The piece probabilities come from expectation maximisation over words of labelled texts.

Fitting takes about ``per_language`` texts of each language, chosen by a hash of the id: the model is bounded, whatever
the input. Scoring is row-local and reads whole texts; a worker keeps word scores within a bound.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text where nothing could be
learned; a character outside the vocabulary is a piece of small probability; ties go to the first language by name;
pieces and
words of any length count in training and scoring, summed with rescaling; repeated rows get equal results; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import at_work, free_name

#: Letters, and combining marks behind one; numerals of any kind are no letters.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
UNDETERMINED = "und"
PER_LANGUAGE = 400
ROUNDS = 4
#: Words whose scores a worker keeps, characters it cuts into words at once, words of one length it scores at once.
CACHE_WORDS = 300_000
BATCH_CHARS = 1 << 20
LATTICE_WORDS = 4_000
#: Places between two rescalings of the sums.
RESCALE = 8


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@dataclass
class Lattice:
    """The pieces that words of one length can be cut into."""

    #: [word, end - 1] to the row of the last letter alone.
    letters: np.ndarray
    #: For each end, its longer pieces: size, the words that have one there, and their rows.
    pieces: list[list[tuple[int, np.ndarray, np.ndarray]]]


@dataclass
class LanguageModel:
    languages: list[str]
    #: Piece to row of ``probabilities``; the last two rows are the unknown character and no piece at all.
    pieces: dict[str, int]
    probabilities: np.ndarray
    kept: dict[str, int] = field(default_factory=dict)
    #: The kept words' log probabilities; rows beyond them are room.
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: Every beginning of a piece to the row of the piece, or -1 if it is none itself; made where words are cut.
    beginnings: dict[str, int] = field(default_factory=dict)

    def forget(self) -> None:
        self.kept.clear()
        self.scores = np.zeros((0, 0))
        self.beginnings.clear()

    def lattice(self, same_length: list[str]) -> Lattice:
        if not self.beginnings:
            self.beginnings.update({p[:n]: -1 for p in self.pieces for n in range(1, len(p))})
            self.beginnings.update(self.pieces)
        n, get, unknown = len(same_length[0]) + 1, self.beginnings.get, len(self.probabilities) - 2
        letters = np.empty((len(same_length), n), np.int32)
        found: list[dict[int, tuple[list[int], list[int]]]] = [{} for _ in range(n)]
        for i, word in enumerate(same_length):
            w = "▁" + word
            row = []
            for begin in range(n):
                at = get(w[begin : begin + 1])
                row.append(unknown if at is None or at < 0 else at)
                end = begin + 1
                while at is not None and end < n:
                    end += 1
                    at = get(w[begin:end])
                    if at is not None and at >= 0:
                        where, rows = found[end - 1].setdefault(end - begin, ([], []))
                        where.append(i)
                        rows.append(at)
            letters[i] = row
        pieces = [[(size, np.array(a), np.array(b, np.int32)) for size, (a, b) in sorted(f.items())] for f in found]
        return Lattice(letters, pieces)

    def forward(self, lattice: Lattice) -> tuple[np.ndarray, tuple[list[np.ndarray], list]]:
        """Log probability of each word per language, and the sums up to each place with the logs of their scales."""
        p, n = self.probabilities, len(lattice.pieces)
        longest = max((size for entries in lattice.pieces for size, _, _ in entries), default=1)
        sums, logs = [np.ones((len(lattice.letters), p.shape[1]))], [0.0]
        for end in range(1, n + 1):
            total = sums[end - 1] * p[lattice.letters[:, end - 1]]
            for size, where, rows in lattice.pieces[end - 1]:
                total[where] += sums[end - size][where] * p[rows]
            sums.append(total)
            logs.append(logs[-1])
            if end % RESCALE == 0 and end < n:
                rescale(sums, logs, range(max(0, end - longest), end + 1), total)
        return np.log(np.maximum(sums[n], 1e-300)) + logs[n], (sums, logs)

    def backward(self, lattice: Lattice) -> tuple[list[np.ndarray], list]:
        """The sums from each place to the end, with the logs of their scales."""
        p, n = self.probabilities, len(lattice.pieces)
        shape, logs = (len(lattice.letters), p.shape[1]), [0.0] * (n + 1)
        sums = [*(np.zeros(shape) for _ in range(n)), np.ones(shape)]
        longest = max((size for entries in lattice.pieces for size, _, _ in entries), default=1)
        # a place is whole once all pieces that begin there, thus end behind it, have been added
        for end in range(n, 0, -1):
            logs[max(0, end - longest)] = logs[end]
            if (n - end) % RESCALE == 0 and end < n:
                rescale(sums, logs, range(max(0, end - longest), end + 1), sums[end])
            sums[end - 1] += sums[end] * p[lattice.letters[:, end - 1]]
            for size, where, rows in lattice.pieces[end - 1]:
                sums[end - size][where] += sums[end][where] * p[rows]
        return sums, logs

    def add(self, new: list[str]) -> None:
        """Score words that are not kept yet."""
        by_length: dict[int, list[str]] = {}
        for word in new:
            by_length.setdefault(len(word), []).append(word)
        for same in by_length.values():
            for begin in range(0, len(same), LATTICE_WORDS):
                part = same[begin : begin + LATTICE_WORDS]
                logs, _ = self.forward(self.lattice(part))
                held = len(self.kept)
                if held + len(part) > len(self.scores):
                    room = np.empty((2 * held + len(part), logs.shape[1]))
                    room[:held] = self.scores[:held] if held else 0
                    self.scores = room
                self.scores[held : held + len(part)] = logs
                self.kept.update(zip(part, range(held, held + len(part)), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        cut = [words(t) for t in texts]
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        self.add(list(set().union(*cut) - self.kept.keys()))
        table, place = self.scores, self.kept.__getitem__
        out = []
        for ws in cut:
            if not ws:
                out.append((UNDETERMINED, 0.0))
                continue
            logs = table[np.fromiter(map(place, ws), np.int64, len(ws))].sum(axis=0)
            # by word, so that long texts are not all equally certain
            shares = np.exp((logs - logs.max()) / len(ws))
            out.append((self.languages[int(logs.argmax())], float(shares.max() / shares.sum())))
        return out


def vocabulary(path: str) -> list[str]:
    """The pieces of a public vocabulary that can be part of a word, by length and content."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    letters = {p for p in found if re.fullmatch(r"▁?[^\W\d_]*", p) and p}
    return sorted(letters | {"▁"}, key=lambda p: (len(p), p))


def train(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """Piece probabilities from word counts per language."""
    languages = sorted(counts)
    rows = {p: i for i, p in enumerate(pieces)}
    start = np.full((len(pieces) + 2, max(1, len(languages))), 1.0 / (len(pieces) + 1))
    start[-1] = 0
    model = LanguageModel(languages, rows, start)
    by_length: dict[int, list[str]] = {}
    for word in sorted(set().union(*counts.values())) if counts else ():
        by_length.setdefault(len(word), []).append(word)
    parts = [same[at : at + LATTICE_WORDS] for _, same in sorted(by_length.items()) for at in range(0, len(same), LATTICE_WORDS)]
    groups = [model.lattice(ws) for ws in parts]
    weights = [np.array([[counts[lang][w] for lang in languages] for w in ws], float) for ws in parts]
    for _ in range(rounds if groups else 0):
        expected = np.zeros_like(model.probabilities)
        for lattice, weight in zip(groups, weights, strict=True):
            expected += expectations(model, lattice, weight)
        expected[-1] = 0
        # a piece that a language has not shown keeps a small share of what all show, or of a uniform piece
        pooled = expected.sum(axis=1, keepdims=True) + 0.1
        pooled[-1] = 0
        mass = expected.sum(axis=0, keepdims=True)
        model.probabilities = 0.98 * expected / np.maximum(mass, 1) + 0.02 * pooled / pooled.sum()
        model.probabilities[-1] = 0
    return model


def rescale(sums: list[np.ndarray], logs: list, places: range, by: np.ndarray) -> None:
    """Divide the sums at ``places``, all on one scale, by a positive number for each word and language."""
    log = logs[places[-1]] + np.log(by)
    for at in places:
        sums[at] = sums[at] / by
        logs[at] = log


def expectations(model: LanguageModel, lattice: Lattice, times: np.ndarray) -> np.ndarray:
    """How often each piece is used in the words, over all segmentations."""
    p, n = model.probabilities, len(lattice.pieces)
    _, (ahead, ahead_logs) = model.forward(lattice)
    back, back_logs = model.backward(lattice)
    share = times / ahead[n]
    used, uses = [], []
    for end in range(1, n + 1):
        for size, where, rows in [(1, slice(None), lattice.letters[:, end - 1]), *lattice.pieces[end - 1]]:
            scale = ahead_logs[end - size] + back_logs[end] - ahead_logs[n]
            part = ahead[end - size][where] * p[rows] * back[end][where] * share[where]
            used.append(rows)
            uses.append(part * np.exp(scale[where]) if isinstance(scale, np.ndarray) else part)
    rows, values = np.concatenate(used), np.concatenate(uses)
    return np.stack([np.bincount(rows, values[:, i], minlength=len(p)) for i in range(p.shape[1])], axis=1)


def fit(labelled: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from about ``per_language`` rows of each non-null language, all rows where there are fewer."""
    rows = labelled.filter(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, size in sizes.items():
        chosen = chosen | ((F.col(lang_col) == lang) & (draw < int(per_language / size * (1 << 20)) + 1))
    sample = rows.filter(chosen).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = Counter()
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words(text))
            langs, ws = zip(*found, strict=True) if found else ((), ())
            arrays = [pa.array(langs, pa.string()), pa.array(ws, pa.string()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for r in counted.collect():  # the words of the sample
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return train(counts, vocabulary(vocabulary_path))


def with_language(docs: DataFrame, model: LanguageModel, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and a column ``name``: struct of lang and score. Only texts are sent to Python."""
    plain = LanguageModel(model.languages, model.pieces, model.probabilities)
    sent = docs.sparkSession.sparkContext.broadcast(plain)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        at_work("langid", own.forget)
        for part in batches:
            found, at = [], 0
            sizes = pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < len(part):
                # texts of BATCH_CHARS together, or one
                end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BATCH_CHARS, side="right")))
                found += own.score(part.slice(at, end - at).to_pylist())
                at = end
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.StructArray.from_arrays([langs, scores], ["lang", "score"])

    # said to be random, so that a filter on it does not score a text again
    judged = F.arrow_udf(judge, "struct<lang: string, score: double>").asNondeterministic()
    return docs.withColumn(name, judged(F.col(text_col).cast("string")))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, lang_pred and score."""
    name = free_name(docs.columns, "_language")
    found = with_language(docs, model, name, text_col)
    return found.select(*[F.col(f"`{c}`") for c in keep], F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
