import json
import random

import pytest
from pyspark.sql import functions as F

from rolesieve.functions import jsonld as J
from rolesieve.session import prepare_session
from tests.helpers import apply


@pytest.fixture(autouse=True)
def settings(spark):
    prepare_session(spark)


def on_json(spark, function, objects):
    return apply(spark, lambda c: function(F.try_parse_json(c)), [json.dumps(o) for o in objects])


def test_parse_accepts_exactly_one_value(spark):
    good = ['{"a": 1}', " [1, 2] ", "3", '"x"', "null", '{"a": 1, "a": 2}', '{"a": "] x, }"}']
    bad = ["", " ", "{", '{"a": 1} x', '{"a": 1}, 2', '{"a": 1}] x', '{"a": 1} {"b": 2}', "{a: 1}", '{"a": "\n"}', None]
    got = apply(spark, lambda c: F.to_json(J.jsonld_parse(c)).isNotNull(), good + bad)
    assert got == [True] * len(good) + [False] * len(bad)


def test_last_of_repeated_keys_counts(spark):
    assert apply(spark, lambda c: J.field_text(J.jsonld_parse(c), "$.a"), ['{"a": 1, "a": 2}']) == ["2"]


def test_job_posting_types(spark):
    yes = [
        "JobPosting", ["JobPosting"], ["Thing", "JobPosting"], "schema:JobPosting", "https://schema.org/JobPosting",
        "http://schema.org/JobPosting", [1, None, "schema:JobPosting"],
    ]
    no = [
        "jobposting", "JobPosting ", "schema:schema:JobPosting", "schema:https://schema.org/JobPosting", [], None, 5,
        {"JobPosting": 1}, ["Thing"], "https://schema.org/Job",
    ]
    assert on_json(spark, J.is_job_posting_type, yes + no) == [True] * len(yes) + [False] * len(no)


def depth_first(value):
    """What the search must find, written as plain recursion."""
    if isinstance(value, dict):
        if value.get("@type") == "JobPosting":
            yield value["n"]
        elif isinstance(value.get("@graph"), list):
            for item in value["@graph"]:
                yield from depth_first(item)
    elif isinstance(value, list):
        for item in value:
            yield from depth_first(item)


def random_tree(rng, depth, counter):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        counter[0] += 1
        return rng.choice([{"@type": "JobPosting", "n": counter[0]}, {"@type": "Thing"}, "text [[", 3, None])
    items = [random_tree(rng, depth - 1, counter) for _ in range(rng.randint(0, 3))]
    return {"@type": "Page", "@graph": items} if kind < 0.6 else items


def test_search_order_and_depth_equal_recursion(spark):
    rng = random.Random(7)
    trees = [random_tree(rng, rng.randint(1, 9), [0]) for _ in range(300)]
    deep = {"@type": "JobPosting", "n": 1}
    for _ in range(40):
        deep = [deep]
    trees.append(deep)
    number = lambda n: F.try_variant_get(n["v"], "$.n", "int")
    texts = [json.dumps(t) for t in trees]
    assert apply(spark, lambda c: F.transform(J.job_postings_in(c), number), texts) == [list(depth_first(t)) for t in trees]
    first = apply(spark, lambda c: F.try_variant_get(J.first_job_posting_in(F.array(c)), "$.n", "int"), texts)
    assert first == [next(depth_first(t), None) for t in trees]


def test_first_block_with_a_posting_wins(spark):
    blocks = ["{ broken", '{"@type": "Thing"}', '[{"@type": "JobPosting", "n": 1}]', '{"@type": "JobPosting", "n": 2}']
    frame = spark.createDataFrame([(blocks,)], "b array<string>")
    found = F.try_variant_get(J.first_job_posting_in(F.col("b")), "$.n", "int")
    assert frame.select(found).collect()[0][0] == 1


def test_field_text(spark):
    cases = {" a ": "a", "": "", 5: "5", True: "True", None: ""}
    assert on_json(spark, lambda v: J.field_text(v, "$.x"), [{"x": k} for k in cases]) == list(cases.values())
    assert on_json(spark, lambda v: J.field_text(v, "$.x"), [{}, [], 3]) == ["", "", ""]


def test_company(spark):
    cases = [
        ({"name": " Acme "}, "Acme"), ("Umbrella ", "Umbrella"), ({}, ""), ({"name": None}, ""), (["x"], ""),
        (5, ""), (None, ""),
    ]
    got = on_json(spark, J.parse_company, [{"hiringOrganization": c} for c, _ in cases] + [{}])
    assert got == [e for _, e in cases] + [""]


def test_location(spark):
    def at(**address):
        return {"jobLocation": {"address": address}}

    cases = [
        (at(addressLocality="SF", addressRegion="CA", addressCountry="US"), "SF, CA"),
        (at(addressLocality="Berlin", addressCountry="Germany"), "Berlin, Germany"),
        (at(addressCountry="US"), "US"),
        (at(addressRegion="CA", addressCountry="USA"), "CA"),
        (at(), ""),
        ({"jobLocation": [{"address": {"addressLocality": "A"}}, {"address": {"addressLocality": "B"}}]}, "A"),
        ({"jobLocation": []}, ""),
        ({"jobLocation": " Paris "}, "Paris"),
        ({"jobLocation": ["Rome"]}, "Rome"),
        ({"jobLocation": {"address": " 1 Main St "}}, "1 Main St"),
        ({"jobLocation": {"address": None}}, ""),
        ({"jobLocation": {"address": ["x"]}}, ""),
        ({"jobLocation": {"name": "x"}}, ""),
        ({"jobLocation": 5}, ""),
        ({"jobLocation": None}, ""),
        ({"jobLocationType": " telecommute ", "jobLocation": "Paris"}, "Remote"),
        ({"jobLocationType": "onsite", "jobLocation": "Paris"}, "Paris"),
        ({}, ""),
    ]
    assert on_json(spark, J.parse_location, [c for c, _ in cases]) == [e for _, e in cases]


def test_date(spark):
    got = on_json(spark, J.parse_date, ["2024-06-01", 20240601, None, "", "soon", ["2024-06-01"]])
    assert [(str(r["date"]), r["confidence"]) for r in got] == [("2024-06-01", "exact")] + [("None", "unknown")] * 5


def test_apply_url(spark):
    source = "https://x/1/"
    urls = ["https://x/1", "https://x/1//", "https://x/2", "", None, " https://x/1/ "]
    got = on_json(spark, lambda v: J.parse_apply_url(v, F.lit(source)), [{"url": u} for u in urls] + [{}])
    assert got == [None, None, "https://x/2", None, None, None, None]


ODD_POSTINGS = [
    {}, {"title": True, "url": False, "jobLocationType": "telecommute"}, {"title": "true", "description": None, "url": 7},
    {"title": ["a"], "description": {"b": 1}, "employmentType": ["FULL_TIME", "INTERN"], "hiringOrganization": " Text "},
    {"hiringOrganization": {"name": True}, "jobLocation": [], "datePosted": 20240601, "url": "https://s/1/"},
    {"hiringOrganization": ["x"], "jobLocation": ["Lyon, France", "Paris"], "datePosted": "2024-W05-3"},
    {"hiringOrganization": {}, "jobLocation": {"address": {"addressLocality": " SF ", "addressCountry": "US"}}},
    {"jobLocation": [{"address": {"addressRegion": True, "addressCountry": "FR"}}], "url": "https://s/2"},
    {"jobLocation": {"address": "true"}}, {"jobLocation": {"address": None}}, {"jobLocation": {"address": ["x"]}}, [1], "x",
]


def test_fields_read_at_once_are_those_read_one_by_one(spark):
    url = F.lit("https://s/1")
    rows = spark.createDataFrame([(json.dumps(p),) for p in ODD_POSTINGS], "raw string").select(J.jsonld_parse(F.col("raw")).alias("v"))
    v = F.col("v")
    single = F.struct(
        J.field_text(v, "$.title").alias("title"), J.parse_company(v).alias("company"),
        J.parse_location(v).alias("location"), J.field_text(v, "$.description").alias("description"),
        J.parse_date(F.try_variant_get(v, "$.datePosted", "variant")).alias("_date"),
        J.parse_apply_url(v, url).alias("apply_url"), J.parse_employment_type(v).alias("employment_type"),
    )
    found = rows.select(J.posting_fields(v, url).alias("once"), single.alias("single")).collect()
    assert [r.once for r in found] == [r.single for r in found]
    assert found[1].once.title == "True" and found[2].once.title == "true"
    assert rows.limit(1).select(J.posting_fields(F.lit(None).cast("variant"), url).alias("f")).collect()[0].f is None
