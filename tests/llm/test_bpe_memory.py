"""What a worker holds while it encodes."""

import tracemalloc

import pyarrow as pa

from rolesieve.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"


def test_a_batch_holds_no_second_copy_of_its_words():
    enc = bpe.Encoding(PATH)
    texts = [" ".join(f"word{k % 50}" for k in range(20_000))] * 20
    enc.encode_batch(texts[:1])
    tracemalloc.start()
    encoded = enc.encode_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a pointer for each piece of the batch, and the pieces of the one text that is being cut
    assert sum(map(len, encoded)) == 400_000 and peak < 8e6


def test_dropped_words_are_encoded_again(monkeypatch):
    whole = bpe.Encoding(PATH)
    monkeypatch.setattr(bpe, "CACHE_ITEMS", 40)
    few = bpe.Encoding(PATH)
    texts = [f"the cat x{k}  sat on {k * k} mats.\n<|endoftext|> naïve{k % 3} 中文{'y' * k}" for k in range(100)] + ["", " "]
    as_ids = lambda found: [",".join(p[1] for p in pieces) for pieces in found]
    got = [as_ids(few.encode_batch([t]))[0] for t in texts]
    assert got == as_ids(whole.encode_batch(texts))
    assert len(few.kept) + len(few.older) < 80
    # what is asked for again and again stays
    assert " cat" in few.kept or " cat" in few.older
    assert [whole.decode(map(int, g.split(","))) if g else "" for g in got] == texts


def test_texts_of_a_column():
    rows = [None, "", *map(str, range(bpe.ROWS * 2))]
    assert list(bpe.texts_of(pa.array(rows))) == ["", *rows[1:]]
    assert list(bpe.texts_of(pa.array([], pa.string()))) == []


def test_words_of_a_batch_are_written_out_together():
    enc = bpe.Encoding(PATH)
    calls = []
    encoded, enc.encoded = enc.encoded, lambda words: calls.append(len(words)) or encoded(words)
    texts = ["", " ", "the cat's  mat.\n", "<|endoftext|>x<|endoftext|>", "naïve 中文   é", "y" * 100 + " y, the", "the the the"]
    found = enc.encode_batch(texts)
    assert len(calls) == 1
    for text, pieces in zip(texts, found, strict=True):
        ids = [int(i) for p in pieces for i in p[1].split(",")]
        assert sum(p[0] for p in pieces) == len(ids)
        assert b"".join(p[2] for p in pieces).decode() == enc.decode(ids) == text
    # a piece that is too long is not kept, even though it waited for its encoding among the kept ones
    assert "y" * 100 not in enc.kept and " the" in enc.kept and all(type(e) is tuple for e in enc.kept.values())


def test_encoded_words_cover_no_words_and_empty_ones():
    enc = bpe.Encoding(PATH)
    assert enc.encoded([]) == {}
    whole = enc.encoded(["", "cat", "ÿ"])
    assert whole[""] == (0, "", b"") and whole["cat"][2] == b"cat" and whole["ÿ"][2] == "ÿ".encode()
    assert [enc.decode(map(int, whole[w][1].split(","))) for w in ("cat", "ÿ")] == ["cat", "ÿ"]
