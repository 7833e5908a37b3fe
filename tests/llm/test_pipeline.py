"""The stages of the corpus pipeline on odd tables, and against plain versions where these are simple."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rolesieve.llm import langid
from rolesieve.llm.common import at_work, free_name, stage
from rolesieve.llm.queries import TOKENIZERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, shard int, _language string"
WORDS = {
    "en": "the house of the river stands near a green field and old trees grow by its wall".split(),
    "de": "das haus am fluss steht nahe bei einem feld und alte bäume wachsen an seiner mauer".split(),
}


def text(lang, seed, n=60):
    return " ".join(WORDS[lang][(seed * 7 + i * i + i * seed) % len(WORDS[lang])] + ("" if i % 9 else f" {seed}x{i}") for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "p", 1.0, 3, "l") for i, t, lang, s in rows], SCHEMA)


def rows():
    out = [(i, text("en" if i % 2 else "de", i), "en" if i % 2 else "de", None if i % 5 == 0 else f"s{i % 3}") for i in range(24)]
    out += [(100, text("en", 1), "en", "s1"), (101, text("en", 1).replace(" ", "\t"), None, "s1"), (102, text("en", 3) + " end", None, "s2")]
    out += [(200, None, "en", "s1"), (201, "", "de", "s1"), (202, "12 ½ ² Ⅷ ① !", "en", "s2"), (None, text("de", 2), None, None)]
    return out + [(300, text("de", 8, 5000), None, "s1"), (301, "ein haus", None, "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, rows())


def test_language_drops_what_has_no_letter_and_names_the_rest(spark, docs):
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.text): r.lang for r in kept.collect()}
    expected = {(i, t): lang for i, t, lang, _ in rows() if t and i != 202}
    assert got.keys() == expected.keys()
    assert all(got[k] == lang for k, lang in expected.items() if lang)
    assert {got[k] for k in got if k[0] in (300, 301)} == {"de"} and {got[k] for k in got if k[0] in (101, 102)} == {"en"}


def test_language_without_labelled_rows(spark, docs):
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(str(r.doc_id) for r in corpus_pipeline.language(spark, none, "").collect()) == sorted(
        str(i) for i, t, _, _ in rows() if t and i != 202
    )
    judged = langid.predict(none, corpus_pipeline.language_model(none))
    assert {r.lang_pred for r in judged.collect()} == {langid.UNDETERMINED}


def test_numerals_are_no_letters_and_marks_stay_in_words():
    assert langid.words("½ ² Ⅷ ① 12 _ ٣") == [] and langid.words(None) == []
    assert langid.words("Hindī हिन्दी x1y é") == ["hindī", "हिन्दी", "x", "y", "é"]
    assert langid.words("́a") == ["a"]


def test_scores_tell_short_from_clear(spark, docs):
    model = corpus_pipeline.language_model(docs)
    got = {r.doc_id: r.score for r in langid.predict(docs, model).collect()}
    assert got[202] == got[200] == got[201] == 0 and 0.5 < got[300] < 1


def test_words_are_scored_alike_in_any_company(spark, docs, monkeypatch):
    model = corpus_pipeline.language_model(docs)
    texts = [t for _, t, _, _ in rows()]
    alone = [langid.LanguageModel(model.languages, model.pieces, model.probabilities).score([t])[0] for t in texts]
    monkeypatch.setattr(langid, "LATTICE_WORDS", 3)
    monkeypatch.setattr(langid, "CACHE_WORDS", 20)
    kept = langid.LanguageModel(model.languages, model.pieces, model.probabilities)
    for together in (kept.score(texts), kept.score(texts[:5]) + kept.score(texts[5:])):
        assert [x[0] for x in together] == [x[0] for x in alone]
        assert all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(together, alone, strict=True))


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_odd_and_empty_tables(spark, docs, at):
    name, function = corpus_pipeline.STAGES[at]
    made, empty = function(spark, docs, ""), function(spark, docs.limit(0), "")
    assert empty.count() == 0 and empty.columns == made.columns
    if at < len(corpus_pipeline.STAGES) - 1:
        assert made.columns == docs.columns, name
    assert made.count() > 0


def test_pipeline_equals_its_parts(spark, tmp_path):
    plain_rows = [r for r in rows() if r[0] is not None]
    frame(spark, plain_rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    # letterless rows went, of equal texts the first stayed, near copies went
    assert not ids & {200, 201, 202, 100, 101} and len(ids & {3, 102}) <= 1
    # the last stage gives what the tokenizer's own library gives for the mixed texts
    mixed = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        mixed = stage(function(spark, mixed, str(tmp_path)), "pipeline-test")
    library, expected = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json"), Counter()
    for r in mixed.collect():
        found = library.encode(r.text, add_special_tokens=False).ids
        expected[(r.doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == expected


def test_names_and_caches_make_way():
    assert free_name(["a", "X", "x_"], "x") == "x__" and free_name([], "x") == "x"
    dropped = []
    at_work("one", lambda: dropped.append("one"))
    at_work("one", lambda: dropped.append("one"))
    at_work("two", lambda: dropped.append("two"))
    at_work("one", lambda: dropped.append("one"))
    assert dropped == ["one", "two"]
