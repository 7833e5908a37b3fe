"""The training-data operators against plain versions on small tables with odd rows."""

import base64
import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesieve.llm import ann, bpe, exact_dedup, langid, licenses, minhash, mixing, sharding, url_filter, warc
from rolesieve.llm.common import normalised
from rolesieve.llm.queries import RULES, TOKENIZERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label string"


def sentence(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


LONG = sentence(3, 4000)
TEXTS = [
    (1, sentence(1, 300)), (2, sentence(1, 300).replace(" ", "\t\n ")), (3, sentence(2, 60)), (4, None), (5, ""),
    (6, " \n "), (7, LONG), (8, LONG + " end"), (9, sentence(1, 300) + " more"), (10, "one two"), (10, "one two"),
    (None, "one two"), (11, sentence(2, 60)), (12, "x" * 5000), (13, "漢字 und é"), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None, "x", "y") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(text):
    out = (text or "").translate(dict.fromkeys(range(9, 14), " "))
    while "  " in out:
        out = out.replace("  ", " ")
    return out


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup_equals_grouping_whole_texts(docs, bits):
    """Two bits make all chunks collide, so identifiers rest on the comparison of their bodies."""
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(plain(t), []).append(i)
    expected = []
    for i, t in TEXTS:
        ids = groups[plain(t)]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256(plain(t).encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs, bits=bits).collect()
    assert Counter(map(tuple, got)) == Counter(expected)


def test_exact_dedup_keeps_columns_and_empty_tables(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({plain(t) for _, t in TEXTS})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_chunks_hold_the_whole_text(docs):
    text = docs.select(normalised(F.col("text")).alias("text"))
    assert text.filter(F.array_join(exact_dedup.chunks(F.col("text")), "") != F.col("text")).count() == 0


def weighted(text, idf):
    words = (text or "").split()
    width = min(5, len(words))
    found = Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - 4)) if width)
    return {s: n * sum(idf[w] for w in s) / width for s, n in found.items()}


def test_near_classes_equal_brute_force(spark):
    texts = [sentence(s, 200) for s in range(4)]
    near = [" ".join("changed" if i in (50 + k, 120) else w for i, w in enumerate(texts[0].split())) for k in range(6)]
    half = [" ".join(texts[1].split()[:110] + texts[2].split()[:90])]
    rows = list(enumerate([*texts, *near, *half, texts[3], "", None, "a b", "a b"]))
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    documents = Counter(w for _, t in rows for w in set((t or "").split()))
    idf = {w: 1 + np.log((1 + len(rows)) / (1 + n)) for w, n in documents.items()}
    sets = [weighted(t, idf) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        least = sum(min(w, sets[b].get(s, 0)) for s, w in sets[a].items())
        whole = sum(sets[a].values()) + sum(sets[b].values()) - least
        if (whole and least / whole >= 0.8) or not (sets[a] or sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(frame).collect()}
    assert got == {i: root(i) for i in range(len(rows))}
    kept = minhash.drop_near_copies(frame)
    assert {r.doc_id for r in kept.collect()} == set(got.values())


@pytest.mark.parametrize("sent", [1 << 18, 50])
def test_word_weights_are_exact(spark, monkeypatch, sent):
    """Also of words beyond those sent around, and where there are more words than any fixed number of counters."""
    monkeypatch.setattr(minhash, "SENT_WORDS", sent)
    texts = [" ".join(f"v{k * 40_000 + i}" for i in range(40_000)) for k in range(8)] if sent > 50 else [sentence(k, 90) for k in range(8)]
    texts += ["the v1 v2", texts[0] + " the", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = Counter(w for t in texts for w in set((t or "").split()))
    idf = minhash.document_frequencies(frame, "text")
    # words of one document need neither
    assert (idf.others is None) == (sum(n > 1 for n in documents.values()) <= sent)
    rows = frame.select(minhash.node(F.col("text")).alias("node"), "text")
    for r in minhash.with_rare_words(rows, idf).collect():
        words = (r.text or "").split()
        hashes = minhash.word_hashes([w.encode() for w in words])
        got = idf.idf(hashes, None if r.words is None else (np.array(r.words), np.array(r.counts)))
        assert np.allclose(got, [1 + np.log((1 + len(texts)) / (1 + documents[w])) for w in words])
    if sent == 50:
        known = np.sort(minhash.word_hashes([f"k{i}".encode() for i in range(3000)]))
        asked = np.concatenate([known, known + np.uint64(1), known - np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        at, found = minhash.Frequencies(3, known, np.ones(3000, np.int64)).known(asked)
        assert (found == np.isin(asked, known)).all() and (known[at[found]] == asked[found]).all()
        bits = minhash.maybe_shared(frame.sparkSession.createDataFrame([(-1,), (5,), (-(1 << 62),)], "word long"))
        words = np.array([-1, 5, -(1 << 62), 4, 6, 1 << 26], np.int64).view(np.uint64)
        assert minhash.holds(bits, words).tolist() == [True, True, True, False, False, False]
        got = {r.doc_id: r.class_id for r in minhash.near_classes(frame).collect()}
        assert got[0] == got[9] == 0 and got[10] == got[11] == 10 and len(set(got.values())) == 10


def test_near_classes_with_odd_rows(docs):
    got = minhash.near_classes(docs)
    assert got.count() == len(TEXTS) and minhash.near_classes(docs.limit(0)).count() == 0


def test_one_row_of_each_class_where_ids_repeat_or_are_null(spark):
    a, b, c = ([*sentence(k, 200).split()] for k in range(3))
    near = lambda words, k: " ".join([*words[:-1], f"end{k}"])
    rows = [(1, near(a, 0)), (1, near(a, 1)), (1, near(a, 2)), (None, near(b, 0)), (None, near(b, 1)), (1, near(c, 0)), (2, near(c, 1))]
    kept = minhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in kept) == sorted([(1, a[0]), (0, b[0]), (1, c[0])])


def test_nearest_equals_brute_force(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(300, 8)).astype(np.float32)
    vectors[100:150] = vectors[3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1050, [0.0] * 8, 1), (1100, [float("nan")] * 8, 1), (1150, [None] * 8, 1), (None, [1.0] * 8, 1), (7, vectors[7].tolist(), 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(frame, frame.filter("vec_id % 50 = 0")).collect()}
    x = vectors.astype(float)
    cosine = x @ x.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    for q in range(0, 300, 50):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-round(cosine[q, i], 12), i))[:5]
        assert [got[q, k + 1][0] for k in range(5)] == order
        assert np.allclose([got[q, k + 1][1] for k in range(5)], cosine[q, order], atol=1e-12)
    assert len(got) == 30
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>", 1), (2, None, "<p>é</p>", 1), (3, "http://b\r\nX: y", "a\r\n\r\nb", 1), (4, "u", None, 1), (5, "u", "", 1), (None, "u", "z", 1), (6, "u", "q" * 300000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page_id, url, html, _ in rows:
        body = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.url) == (len(body), url)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert [got[i].refers_to for i in (1, 2, 4, 5)] == [2, None, 5, None]
    assert [got[i].record_type for i in (1, 2, 4, 5)] == ["revisit", "response", "revisit", "response"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    library = Tokenizer.from_file(path)
    odd = ["aaaaaaa" * 9, " lead  two\t\ttabs \n x ", "it's <|endoftext|>b'll", "x\x85y\x1cz\u3000 w", "😀́½²", "naïve 12ab"]
    extra = docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    expected = Counter()
    for r in rows.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[r.doc_id, len(ids), tuple(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    encoded = bpe.encode_documents(rows, path, with_ids=True)
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in encoded.collect()) == expected
    decoded = bpe.decode_documents(encoded.filter("doc_id >= 100"), path).collect()
    assert {r.text for r in decoded} == set(odd)
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


def test_language_by_held_out_accuracy(spark):
    samples = {"en": "the cat and the house with them of this", "de": "der hund und die katze mit dem auf", "fr": "le chat et la maison avec les des"}
    rows = [(10 * k + i, " ".join(np.random.default_rng(i).permutation((t + " ").split() * 3)), lang, "z") for k, (lang, t) in enumerate(samples.items()) for i in range(10)]
    rows += [(900, None, "en", "z"), (901, "12 !?", "en", "z"), (902, "the " * 5000, None, "z"), (903, "ж" * 500, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(frame.filter(~langid.held_out(F.col("doc_id"))), f"{TOKENIZERS}/piece_bpe_32k.model")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame, model).collect()}
    assert all(got[i][0] == lang for i, _, lang, _ in rows[:30])
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] == "en" and 0 <= got[903][1] <= 1
    assert langid.predict(frame.limit(0), model).count() == 0
    assert langid.fit(frame.limit(0), f"{TOKENIZERS}/piece_bpe_32k.model").languages == []


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "▁", "ab", "▁a", "▁ab"]
    model = langid.LanguageModel(["x"], {p: i for i, p in enumerate(pieces)}, np.array([[0.1], [0.2], [0.05], [0.3], [0.15], [0.4], [1e-3], [0.0]]))
    p = dict(zip(pieces, model.probabilities[:, 0], strict=False))
    total = p["▁"] * p["a"] * p["b"] + p["▁"] * p["ab"] + p["▁a"] * p["b"] + p["▁ab"]
    logs, _ = model.forward(model.lattice(["ab"]))
    assert np.isclose(np.exp(logs[0, 0]), total)


def test_long_pieces_and_long_words_count():
    pieces = langid.vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    assert {"ability", "account"} <= set(pieces)
    rows, p = {w: i for i, w in enumerate(pieces)}, np.random.default_rng(1).random((len(pieces) + 2, 2))
    p[-1] = 0
    model = langid.LanguageModel(["x", "y"], rows, p / p.sum(axis=0))

    def plain(word, counts=None):
        """The sum over all segmentations, and the expected uses of each piece, with exact products."""
        w, n = "▁" + word, len(word) + 1
        row = lambda b, e: rows.get(w[b:e], len(p) - 2 if e - b == 1 else -1)
        ahead, back = [np.ones(2)] + [np.zeros(2)] * n, [np.zeros(2)] * n + [np.ones(2)]
        for e in range(1, n + 1):
            ahead[e] = sum(ahead[b] * model.probabilities[row(b, e)] for b in range(e))
        for b in range(n - 1, -1, -1):
            back[b] = sum(back[e] * model.probabilities[row(b, e)] for e in range(b + 1, n + 1))
        uses = np.zeros_like(p)
        for b, e in itertools.combinations(range(n + 1), 2):
            uses[row(b, e)] += ahead[b] * model.probabilities[row(b, e)] * back[e] / ahead[n]
        return np.log(ahead[n]), uses

    for word in ("accountability", "internationalisation", "ability", "x", "accountability" * 3):
        logs, uses = plain(word)
        lattice = model.lattice([word])
        assert np.allclose(model.forward(lattice)[0][0], logs)
        uses[-1] = 0
        assert np.allclose(langid.expectations(model, lattice, np.ones((1, 2))), uses)
    # one word of more than 200 letters is all there is to learn from
    learned = langid.train({"x": Counter({"account" * 300: 2}), "y": Counter({"ability" * 300: 1})}, pieces)
    assert np.isfinite(learned.probabilities).all() and np.allclose(learned.probabilities.sum(axis=0), 1)
    assert [r[0] for r in learned.score(["account", "ability", "ability" * 500])] == ["x", "y", "y"]


def test_mix_reaches_targets(spark, docs):
    rows = [(i, sentence(i, 1 + (i * 37) % 400), f"s{i % 4}" if i % 7 else None) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(docs.select("doc_id", "text", "source"))
    got = mixing.mix_counts(frame, block_words=16, shard_slots=50).collect()
    assert len(got) == frame.count() and all(r.taken <= 2 * r["size"] for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(target - taken) <= 1 for target, taken in by_source.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_counts(frame, block_words=16, shard_slots=50).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = mixing.mix_counts(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in mixed.collect()) == counts
    assert mixing.mix_counts(frame.limit(0)).count() == 0


def test_permutation_is_one_and_has_an_inverse(spark):
    at = spark.range(1000).withColumn("to", mixing.permuted(F.col("id"), F.lit(1000), F.lit(3), 7))
    at = at.withColumn("back", mixing.permuted(F.col("to"), F.lit(1000), F.lit(3), 7, inverse=True))
    rows = at.collect()
    assert sorted(r.to for r in rows) == list(range(1000)) and all(r.back == r.id for r in rows)


def test_shards_and_curve(spark, docs):
    cube = spark.range(512).select(*[F.shiftright("id", 3 * i).bitwiseAND(7).cast("int").alias(c) for i, c in enumerate("xyz")])
    walk = sorted(cube.withColumn("h", sharding.hilbert_index(F.col("x"), F.col("y"), F.col("z"), 3)).collect(), key=lambda r: r.h)
    assert [r.h for r in walk] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in itertools.pairwise(walk))
    got = sharding.shard_rows(docs, shards=4).collect()
    assert Counter(r.shard for r in got) == {0: 4, 1: 4, 2: 4, 3: 4}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(4)) for s in range(4))
    assert {r["size"] for r in got if r.doc_id == 4} == {8}
    assert sharding.shard_rows(docs.limit(0)).count() == 0 and len(sharding.shard_rows(docs.limit(3)).collect()) == 3


def test_shards_hold_every_row_once(spark, docs, tmp_path):
    """Also where ids repeat or are null."""
    hot = [(None if k % 2 else 7, sentence(k % 3, 20), "en", f"s{k % 2}", k, "x", "y") for k in range(60)]
    frame = docs.unionByName(spark.createDataFrame(hot, SCHEMA))
    sharding.write_shards(frame, str(tmp_path / "shards"), shards=5)
    written = spark.read.parquet(str(tmp_path / "shards"))
    rows = written.collect()
    assert Counter(tuple(r[c] for c in frame.columns) for r in rows) == Counter(map(tuple, frame.collect()))
    assert sorted(Counter(r.shard for r in rows).values()) == [15, 15, 15, 15, 16]
    in_order = sorted(rows, key=lambda r: (r.shard, r._slot))
    assert [r._cell for r in in_order] == sorted(r._cell for r in rows)
    assert len({(r.shard, r._slot) for r in rows}) == len(rows)


def test_url_rules_and_model(spark):
    rows = [(1, "http://EXAMPLE.com/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "http://a.net/es/1"), (4, "http://a.net"), (5, None), (6, "no scheme"), (7, "http://xcom/"), (8, "ftp://é.com/p://q")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    labelled = [(f"http://good{i}.org/a", 0) for i in range(60)] + [(f"http://bad.biz/{'9' * 20}{i}?a=1&b=2", 1) for i in range(60)]
    model = url_filter.fit(spark.createDataFrame(labelled, "url string, label int"), trees=3)
    got = {r.page_id: r for r in url_filter.judge(pages, model, RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 9)] == [
        ("example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("a.net", "/es/1", "net/es/"),
        ("a.net", "", None), ("", "", None), ("", "", None), ("xcom", "/", None), ("é.com", "/p://q", "com/"),
    ]
    assert [got[i].verdict for i in (1, 2, 3, 8)] == ["block", "allow", "block", "allow"]
    held = spark.createDataFrame([(1, "http://good99.org/a", ""), (2, "http://bad.biz/" + "9" * 21 + "?a=1&b=3", "")], "page_id long, url string, host string")
    assert [r.verdict for r in sorted(url_filter.judge(held, model, []).collect())] == ["allow", "block"]
    none = url_filter.fit(spark.createDataFrame([], "url string, label int"))
    assert {r.verdict for r in url_filter.judge(held, none, []).collect()} == {"allow"}


def test_license_scan(spark):
    model = licenses.fit(spark, variants=8)
    filler = sentence(1, 50)
    cases = {
        1: (f"{filler}\nReleased under the MIT License.\n{filler}", "mit"),
        2: (f"{filler} Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        3: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        4: ("This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "gpl,mit"),
        5: (None, None), 6: ("", None), 7: ("He was licensed to drive a bus in the version of the city.", None), 8: (LONG * 3, None),
    }
    frame = spark.createDataFrame([(i, t, "x") for i, (t, _) in cases.items()], "doc_id long, text string, found string")
    got = {r.doc_id: r.licenses for r in licenses.scan(frame, model).collect()}
    assert got == {i: want for i, (_, want) in cases.items()}
    assert licenses.scan(frame.limit(0), model).count() == 0


def test_license_notices_among_other_words(spark):
    model = licenses.fit(spark, variants=8)
    filler = sentence(1, 50)
    cases = {
        1: ("Licensed under the Apache License, Version 2.0 (see the LICENSE file for details)", "apache-2.0"),
        2: ("The code in this repository is licensed under the MIT License, see LICENSE for more", "mit"),
        3: ("This package is distributed by its authors and released under the MIT License", "mit"),
        4: ("(c) 2021 Foo Media Group, all rights reserved", "proprietary"),
        5: (f"{filler} Licensed under the Apache License, Version 2.0 {filler}", "apache-2.0"),
        6: (f"{filler} released under the MIT License or licensed under the Apache License, Version 2.0 {filler}", "apache-2.0,mit"),
        7: (f"{filler} This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License {filler}", "cc-by-sa"),
        8: (f"{filler} the children were under the table and all had rights reserved {filler}", None),
    }
    frame = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(frame, model).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: want for i, (_, want) in cases.items()}
    assert [got[i].n_paragraphs for i in range(1, 9)] == [1] * 7 + [0] and len(got[6].found) == 2


def test_shards_of_a_table_that_has_such_columns(spark):
    rows = [(i, sentence(i, 20 + i), f"s{i % 3}", i, -i, 7, "r") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long, _slot long, _cell int, row string")
    got = sharding.shard_rows(frame, shards=7).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [8, 8, 8, 9, 9, 9, 9]
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in got).items())
    assert {r.doc_id for r in got} == set(range(60))
