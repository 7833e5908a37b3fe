"""Byte-level BPE by a pair occurrence index.

A task cuts its texts into words by the tokenizer's pattern and encodes each distinct word once. The words of a batch
are laid out as one row of symbols; an index maps each pair of neighbouring symbols to all its places in that row. The
ranks present are applied in ascending order: a merge visits the places of its pair from left to right, joins them,
and enters the new neighbours into the index. Encoded words are kept by the worker, within a bound, for later batches.

Nothing is shuffled; a task holds one Arrow batch and the word cache.

Edge cases: a null text counts as empty and gives no tokens (the digest of the empty string); special tokens written
in a text become their ids, as the tokenizers library has it; texts of any length are encoded whole; repeated rows get
equal results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rolesieve.llm.common import at_work

#: The word pattern of the byte-level tokenizer; white space is spelled out because \s differs between engines.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: White space other than the blank.
OTHER_SPACES = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE_ITEMS = 200_000
CACHED_LENGTH = 64
#: Characters encoded together; a longer text goes alone.
BATCH_CHARS = 4 << 20
#: Rows of an Arrow batch whose texts become Python strings together.
ROWS = 256
#: Number of ids, the decimal ids joined by commas, the bytes the ids stand for.
Encoded = Sequence[int | str | bytes]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 0x100
    for b in range(256):
        letters.append(chr(b) if b in printable else chr(extra))
        extra += b not in printable
    return letters


class Encoding:
    """Ranks and ids of a tokenizer file; encodes and decodes with the words it has seen kept."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: by rank: left id, right id, merged id
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in self.merges])
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        #: by id: its decimal form with a comma behind it, the bytes it stands for
        numbers = range(max(self.bytes_of, default=-1) + 1)
        self.id_texts = pa.array([f"{i}," for i in numbers], pa.large_string())
        self.id_bytes = pa.array([self.bytes_of.get(i, b"") for i in numbers], pa.large_binary())
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        #: encoded pieces seen of late, and those before; what is not asked for while the first fills up is dropped
        self.kept: dict[str, Encoded] = {}
        self.older: dict[str, Encoded] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's end in it. One index of pairs serves all words of the call."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbols)
        ends = np.cumsum(lengths)
        # one place more: the neighbour of a word's ends
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[lengths > 0] - 1] = n
        before[(ends - lengths)[lengths > 0]] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = self.ranks_of(symbols[places], symbols[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if len(ranks) > 1:
                order = np.argsort(ranks, kind="stable")
                places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            first = 0
            for rank, last in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), [*cuts.tolist(), len(ranks)], strict=False):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places[first:last])
                first = last

        enter(np.flatnonzero(after[:n] < n))
        while active:
            rank = heapq.heappop(active)
            left, right, merged = self.merges[rank]
            lists = index.pop(rank)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            follows = after[places]
            # without the places that an earlier merge changed
            valid = (symbols[places] == left) & (symbols[follows] == right)
            places, follows = places[valid], follows[valid]
            if left == right and len(places) > 1:
                # of places in a row every second merges, from the left
                linked = np.append(False, follows[:-1] == places[1:])
                starts = np.flatnonzero(~linked)
                even = (np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))) % 2 == 0
                places, follows = places[even], follows[even]
            if not len(places):
                continue
            beyond = after[follows]
            symbols[places], symbols[follows] = merged, -1
            after[places] = beyond
            before[beyond] = places
            ahead = before[places]
            enter(np.concatenate([ahead[ahead < n], places[beyond < n]]))
        alive = symbols[:n] >= 0
        counts = np.add.reduceat(np.append(alive, False), np.minimum(ends - lengths, n)) if n else np.zeros(len(raw), int)
        counts[lengths == 0] = 0
        return symbols[:n][alive], np.cumsum(counts)

    def encoded(self, words: list[str]) -> dict[str, Encoded]:
        """Each word with its encoding. Ids are written out and turned into bytes for all words together, then cut."""
        ids, stops = self.encode_words(words)
        starts = np.append(0, stops)
        (texts, t), (raw, r) = [_laid_out(table, ids, starts) for table in (self.id_texts, self.id_bytes)]
        texts = texts.decode()
        # a comma ends the text of each word that has an id
        return {
            w: (n, texts[a : b - 1] if n else "", raw[c:d])
            for w, n, a, b, c, d in zip(words, np.diff(starts).tolist(), t, t[1:], r, r[1:], strict=False)
        }

    def pieces(self, text: str) -> list[str]:
        """The text in pieces that are words or runs of words: a lone blank always starts a word, so texts without
        other white space around blanks are cut there; the rest goes through the pattern."""
        if not text:
            return []
        if "  " in text or text[0].isspace() or text[-1].isspace():
            return self.words.findall(text)
        if any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACES):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def words_of(self, piece: str) -> list[str]:
        if piece in self.special:
            return [piece]
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return [piece]
        if piece[-1] in ".," and piece[1:-1].isalpha() and piece[0] == " ":
            return [piece[:-1], piece[-1]]
        return self.words.findall(piece)

    def encode_batch(self, texts: Iterable[str]) -> list[list[Encoded]]:
        """Each text as a list of encoded pieces; they are shared between texts. A text's own pieces are dropped once they
        are looked up: of those not kept, one each waits for its encoding in ``new``."""
        if len(self.kept) > CACHE_ITEMS // 2:
            self.older, self.kept = self.kept, {}
        kept, older, new = self.kept, self.older, {}
        found = []
        for text in texts:
            pieces, at = [], 0
            for m in self.specials.finditer(text) if self.special else ():
                pieces += self.pieces(text[at : m.start()])
                pieces.append(m.group())
                at = m.end()
            pieces += self.pieces(text[at:])
            encoded = list(map(kept.get, pieces))
            for at in [i for i, e in enumerate(encoded) if e is None]:
                p = pieces[at]
                e = kept.get(p)
                if e is None:
                    e = older.get(p)
                    if e is None:
                        e = new[p] = []
                    kept[p] = e
                encoded[at] = e
            found.append(encoded)
        # most pieces are one word with a blank before it
        words = {p: self.words_of(p) for p in new if not (p[0] == " " and p[1:].isalpha())}
        distinct = list(set(chain(*words.values(), new.keys() - words.keys())) - self.special.keys())
        encodings = self.encoded(distinct)
        for content, i in self.special.items():
            encodings[content] = 1, str(i), self.bytes_of[i]
        for piece, waiting in new.items():
            encoding = encodings.get(piece)
            if encoding is None:
                counts, texts, raw = zip(*map(encodings.__getitem__, words[piece]), strict=True)
                encoding = sum(counts), ",".join(texts), b"".join(raw)
            waiting += encoding
            if len(piece) <= CACHED_LENGTH:
                kept[piece] = encoding
            else:
                del kept[piece]
        return found

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _laid_out(table: pa.Array, ids: np.ndarray, places: np.ndarray) -> tuple[bytes, list[int]]:
    """The entries of ``table`` (strings or bytes with long offsets) for ``ids`` in a row, and the byte at which each of
    ``places`` among the ids lies."""
    taken = table.take(pa.array(ids))
    offsets, data = taken.buffers()[1:]
    if not len(ids):
        return b"", [0] * len(places)
    return data.to_pybytes(), np.frombuffer(offsets, np.int64)[places].tolist()


_open: dict[str, Encoding] = {}


def encoding(path: str) -> Encoding:
    """The encoding of a worker, read once."""
    at_work("bpe", _open.clear)
    if path not in _open:
        _open[path] = Encoding(path)
    return _open[path]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of a column, null as empty, without a second copy of the whole column."""
    for at in range(0, len(column), ROWS):
        yield from ["" if t is None else t for t in column.slice(at, ROWS).to_pylist()]


def by_size(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """The texts in groups of ``most`` characters or one text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the text
    decoded from the ids), and the ids themselves if asked for. ``path`` names the tokenizer file on every worker."""
    source = docs.select(id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for part in batches:
            counts, digests, decoded, all_ids = [], [], [], []
            for group in by_size(texts_of(part.column(1)), BATCH_CHARS):
                for pieces in enc.encode_batch(group):
                    joined = ",".join([p[1] for p in pieces])
                    counts.append(sum([p[0] for p in pieces]))
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    text = b"".join([p[2] for p in pieces]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                    if with_ids:
                        all_ids.append(list(map(int, joined.split(","))) if joined else [])
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids) to (id, text)."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for part in batches:
            texts = [None if ids is None else enc.decode(ids) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")
