import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rolesieve.functions.hashing import posting_hash
from rolesieve.functions.text import (
    FEW_PHRASES,
    any_keyword,
    kw_match,
    matched_keywords,
    phrases_in,
    string_array,
    strip,
    words_of,
)
from tests.helpers import apply

ODD = list("aZ_0é ß́²Ⅷ-+. 　\x1c\x85​\n'")


def random_texts(n, alphabet, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, length))) for _ in range(n)]


def test_strip_equals_python(spark):
    texts = random_texts(500, ODD, 6, 1) + ["", "  a b  ", "\t\n\x0b\x0c x  "]
    assert apply(spark, strip, texts) == [t.strip() for t in texts]


@pytest.mark.parametrize("keyword", ["a", "a-a", "é", "a a", "a+", "_0", ".a"])
def test_keyword_equals_python_regex(spark, keyword):
    texts = random_texts(800, ["a", "a", keyword, *ODD], 5, len(keyword))

    def expected(text):
        if " " in keyword:
            return keyword in text
        return re.search(rf"\b{re.escape(keyword)}\b", text) is not None

    got = apply(spark, lambda c: kw_match(keyword, c), texts)
    assert got == [expected(t) for t in texts]
    assert any(got)


def test_words_equal_python(spark):
    texts = random_texts(400, ODD, 8, 3)
    got = apply(spark, words_of, texts)
    assert [[w for w in ws if w] for ws in got] == [re.findall(r"\w+", t) for t in texts]


def test_hash_ignores_case_and_outer_space_only(spark):
    import hashlib

    rows = [("SWE Intern", "Acme", "https://X/1"), (" swe intern ", "ACME", "https://x/1 "), ("SWE  Intern", "Acme", "https://x/1")]
    frame = spark.createDataFrame(rows, "t string, c string, u string")
    got = [r[0] for r in frame.select(posting_hash(F.col("t"), F.col("c"), F.col("u"))).collect()]
    expected = hashlib.sha256("swe intern\x00acme\x00https://x/1".encode()).hexdigest()
    assert got[0] == got[1] == expected
    assert got[2] != expected


def test_many_phrases_equal_searching_one_by_one(spark):
    draw = random.Random(5)
    words = ["a", "bc", "bcd", "de", "it", "intern", "é", "x-y", ""]
    phrases = [" ".join(draw.choice(words) for _ in range(draw.randint(2, 4))) for _ in range(900)]
    phrases += ["  ", " ", "   a", "b  "]
    texts = ["", " ", "  ", "a", "it intern", "audit internal", "bcd  de", "ébc ded", "x-y it"]
    texts += [" ".join(draw.choice(["a", "abc", "bcde", "audit", "internship", "éa", "x-yé", ""]) for _ in range(12)) for _ in range(80)]
    unique = list(dict.fromkeys(phrases))
    assert len(unique) > FEW_PHRASES
    got = apply(spark, lambda t: matched_keywords(phrases, t, string_array([])), texts)
    assert [sorted(g) for g in got] == [sorted(p for p in unique if p in t) for t in texts]
    some = apply(spark, lambda t: any_keyword(phrases[:300], t, string_array([])), texts)
    assert some == [any(p in t for p in phrases[:300]) for t in texts]


def test_many_phrases_cost_about_as_much_as_few(spark):
    """The text is gone through once per number of blanks, not once per phrase."""
    letters = "adeilnorst"
    pieces = [a + b for a in letters for b in letters]
    many = [f"{a} {b}" for a in pieces for b in pieces]
    rows = spark.range(400).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.substring(
        F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256), F.lit(1), (i % 7 + 2).cast("int")))).alias("t"))
    rows = rows.select(F.translate("t", "0123456789", letters).alias("t"))
    rows.write.format("noop").mode("overwrite").save()
    times = []
    for listed in (many[::100], many):
        df = rows.select(F.size(phrases_in(listed, F.col("t"))).alias("n"))
        df.agg(F.sum("n")).collect()
        started = time.perf_counter()
        df.agg(F.sum("n")).collect()
        times.append(time.perf_counter() - started)
    assert times[1] < 8 * times[0] + 2, times
