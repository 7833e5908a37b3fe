import datetime as dt
import html
import html.entities

from rolesieve.functions.html import head_tokens, jsonld_scripts, meta_attributes, meta_source, unescape_html
from rolesieve.operators.extraction import (
    extract_pages,
    first_job_posting,
    jsonld_blocks,
    jsonld_walk,
    meta_fallback,
)
from rolesieve.functions.jsonld import field_text
from rolesieve.session import prepare_session
from pyspark.sql import functions as F
from tests.helpers import apply, crawl, ld, tree


def one(spark, html, **fetched):
    page = crawl(spark, ("https://x/1", html, fetched.get("status", 200), fetched.get("error", "")))
    return extract_pages(page).collect()[0]


def test_full_posting(spark):
    row = one(
        spark,
        "<html><head><title>ignored</title></head>"
        + ld({
            "@type": "JobPosting", "title": " SWE ", "description": "Build.", "datePosted": "2024-06-01",
            "employmentType": "INTERN", "hiringOrganization": {"name": "Acme"}, "url": "https://apply/1",
            "jobLocation": {"address": {"addressLocality": "SF", "addressRegion": "CA", "addressCountry": "US"}},
        }),
    )
    assert (row.title, row.company, row.location, row.description) == ("SWE", "Acme", "SF, CA", "Build.")
    assert (row.date_posted, row.date_posted_confidence) == (dt.date(2024, 6, 1), "exact")
    assert (row.apply_url, row.employment_type, row.blocked) == ("https://apply/1", "INTERN", False)


def test_structured_data_wins_wholly(spark):
    row = one(spark, '<meta property="og:title" content="OG"><meta property="og:description" content="D">'
              + ld({"@type": "JobPosting", "title": "LD"}))
    assert (row.title, row.description) == ("LD", "")


def test_malformed_block_is_skipped(spark):
    assert one(spark, ld("{ not json }", {"@type": "JobPosting", "title": "Valid"})).title == "Valid"


def test_blocked_pages_keep_defaults(spark):
    html = ld({"@type": "JobPosting", "title": "X"})
    for fetched in ({"status": 403}, {"status": 599}, {"error": "timeout"}):
        row = one(spark, html, **fetched)
        assert (row.blocked, row.title, row.date_posted_confidence) == (True, "", "unknown")
    for status in (0, 201, 399, 600):
        row = one(spark, html, status=status)
        assert (row.blocked, row.title) == (False, "X")


def test_nothing_found(spark):
    for html in ("", "<html><body><h1>SWE</h1></body></html>", None):
        row = one(spark, html)
        assert (row.title, row.company, row.location, row.description, row.apply_url) == ("", "", "", "", None)
        assert row.blocked is False


def test_which_scripts_count(spark):
    body = '{"a": 1}'
    yes = [
        f'<script type="application/ld+json">{body}</script>',
        f"<SCRIPT id=x TYPE = 'application/ld+json' >{body}</SCRIPT >",
        f"<script type=application/ld+json>{body}</script>",
        f'<script type="application/ld&#43;json">{body}</script>',
        f'<script>if (a < b) {{}}</script><script type="application/ld+json">{body}</script>',
    ]
    no = [
        f'<!-- <script type="application/ld+json">{body}</script> -->',
        f'<script type="application/ld+json; charset=utf-8">{body}</script>',
        f'<script type="APPLICATION/LD+JSON">{body}</script>',
        f'<script data-type="application/ld+json">{body}</script>',
        f'<script>var s = \'<script type="application/ld+json">{body}\';</script>',
        "<p>application/ld+json</p>",
    ]
    assert apply(spark, jsonld_scripts, yes + no) == [[body]] * len(yes) + [[]] * len(no)


def test_meta_fallback(spark):
    pages = [
        ("og", '<title>T</title><meta property="og:title" content=" A &amp; B "/>'
               "<meta property='og:site_name' content='Co'><meta property=og:description content=\"x > y\">"
               '<meta name="description" content="no">'),
        ("name", '<TITLE lang="en">\n Job  One \n</TITLE><META CONTENT="D" NAME="description">'),
        ("empty", '<title>T</title><meta property="og:title" content=""><meta property="og:title" content="second">'),
        ("hidden", '<!-- <title>No</title> --><script>"<title>No</title>"</script><style>/*<meta name="description" '
                   'content="no">*/</style><title>Yes</title>'),
        ("case", '<meta property="OG:title" content="no"><title>T</title>'),
        ("inside", '<meta content="property=og:title" name="x"><title>T</title>'),
    ]
    got = {r.url: (r.title, r.company, r.description) for r in meta_fallback(crawl(spark, *pages)).collect()}
    assert got == {
        "og": ("A & B", "Co", "x > y"), "name": ("Job  One", "", "D"), "empty": ("T", "", ""),
        "hidden": ("Yes", "", ""), "case": ("T", "", ""), "inside": ("T", "", ""),
    }


def test_long_meta_tag_does_not_overflow(spark):
    tag = "<meta " + "a='1' " * 5000 + 'property="og:title" content="Long">'
    page = crawl(spark, ("long", tag + "<!-- " * 2000), ("quotes", "<meta " + '"' * 20001 + "><title>T</title>"))
    got = {r.url: r.title for r in meta_fallback(page).collect()}
    assert got["long"] == "Long"


def test_entities(spark):
    cases = {
        "a &amp; b": "a & b", "&lt;&gt;&quot;&apos;": "<>\"'", "&eacute;&ndash;&euro;": "é–€", "&#39;&#x27;&#X1F600;": "''😀",
        "&#146;&#150;": "’–", "&#0;&#xD800;&#1114112;": "�" * 3, "&bogus; & x;": "&bogus; & x;", "AT&T": "AT&T",
        "&amp;amp;": "&amp;", "": "", "a &amp": "a &", "&amp &copy=1 &lang=en &ampx": "& ©=1 &lang=en &x",
        "&#39 &#x27x": "' 'x", "R&D;": "R&D;", "a & b &": "a & b &",
    }
    assert apply(spark, unescape_html, list(cases)) == list(cases.values())


def test_walk_numbers_blocks_and_postings(spark):
    page = crawl(
        spark,
        ("u", ld({"@type": "Thing"}, [{"@type": "JobPosting", "title": "a"}, {"@graph": [{"@type": "JobPosting", "title": "b"}]}],
                 {"@type": "JobPosting", "title": "c"})),
    )
    walk = jsonld_walk(jsonld_blocks(page))
    titles = walk.select("blk", "pos", field_text(F.col("v"), "$.title").alias("t")).collect()
    assert sorted(tuple(r) for r in titles) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    assert [r.t for r in first_job_posting(walk).select(field_text(F.col("v"), "$.title").alias("t")).collect()] == ["a"]


def test_page_is_not_shuffled_and_parsed_once(spark):
    page = crawl(spark, ("u", ld({"@type": "JobPosting", "title": "a"})))
    plan = tree(extract_pages(page).filter("title <> '' AND date_posted IS NULL"))
    assert "Exchange" not in plan
    assert plan.count("parseJson(") == 1
    assert plan.index("Filter") < plan.index("Generate inline")


def test_title_of_a_meta_tag_with_many_pieces_and_a_quoted_bracket(spark):
    attributes = " ".join(f'data-{i}="{i}"' for i in range(2000))
    source = f'<meta {attributes} content="x > y" property="og:title">'
    tokens = apply(spark, lambda h: meta_source(meta_attributes(head_tokens(h)), "property", "og:title"), [source])
    assert tokens == ["x > y"]


def test_numeric_references_with_leading_zeros_and_out_of_range(spark):
    texts = ["&#0000000038;", "&#x00000041;", "&#99999999;", "&#x1234567;", "&#0;", "&#128;", "&#1114112;"]
    assert apply(spark, unescape_html, texts) == [html.unescape(t) for t in texts]


def test_named_references_are_those_of_the_standard_library(spark):
    names = [f"&{name}" for name in html.entities.html5]
    texts = [*names, *[f"x{n}y" for n in names], *[f"{n[:-1]}2" for n in names], "&NotEqualTilde;&nGt;", "&ampfoo", "&copy2024",
             "&nbspx &middotx", "&;&&#;&#x;", "&notit;", "&#1;&#11;&#13;&#127;&#129;&#xFDD0;&#x1FFFF;", "&" + "a" * 40 + ";"]
    assert apply(spark, unescape_html, texts) == [html.unescape(t) for t in texts]


def test_numbers_that_json_does_not_have(spark):
    prepare_session(spark)
    cases = {
        '{"@type":"JobPosting","title":"A","x":NaN}': "A",
        '{"@type":"JobPosting","title":"B","x":[-Infinity, Infinity ,NaN]}': "B",
        '{"@type":"JobPosting","title":"NaN, \\"Infinity\\" \\\\","x":NaN}': 'NaN, "Infinity" \\',
        '{"@type":"JobPosting","title":"-Infinity NaN"}': "-Infinity NaN",
        '{"@type":"JobPosting","title":NaN}': "nan",
        '{"@type":"JobPosting","title":-Infinity}': "-inf",
        '{"@type":"JobPosting","title":"C","x":-NaN}': None,
        '{"@type":"JobPosting","title":"C","x":NaNs}': None,
        '{"@type":"JobPosting","title":"C","x":1NaN}': None,
        '{"@type":"JobPosting","title":"C","x":nan}': None,
    }
    pages = crawl(spark, *[(str(i), ld(body)) for i, body in enumerate(cases)])
    got = {r.url: r.title for r in extract_pages(pages).collect()}
    assert got == {str(i): title or "" for i, title in enumerate(cases.values())}


def test_types_in_nested_lists(spark):
    prepare_session(spark)
    types = {
        '[["JobPosting"]]': True, '[[["x",["https://schema.org/JobPosting"]]]]': True, '["a",["b"]]': False, "[[]]": False,
        '[[{"a":"JobPosting"}]]': False, '[{"@type":"JobPosting"}]': False, '["[\\"JobPosting\\"]"]': False, "[[1,null],[true]]": False,
        '["x",["JobPosting"]]': True, "[" * 60 + '"JobPosting"' + "]" * 60: True,
    }
    pages = crawl(spark, *[(str(i), ld('{"@type":%s,"title":"T"}' % t)) for i, t in enumerate(types)])
    got = {r.url: r.title == "T" for r in extract_pages(pages).collect()}
    assert got == {str(i): hit for i, hit in enumerate(types.values())}


def test_script_tags_with_a_quoted_bracket(spark):
    body = '{"@type":"JobPosting","title":"T"}'
    tags = {
        '<script data-x="a>b" type="application/ld+json">': "T", "<script type='application/ld+json' data-x='>'>": "T",
        '<script data-x="1 > 0"\ndata-y=\'">"\' TYPE=application/ld+json id=">">': "T", '<script data-x="type=application/ld+json">': "",
        '<script data-type="application/ld+json">': "", '<script data-x="> type=" id="application/ld+json">': "",
        "<script type=application/ld+json data-x='>": "T", '<script async type = "application/ld+json" >': "T",
    }
    pages = crawl(spark, *[(str(i), f"<p>x</p>{tag}{body}</script><p>y</p>") for i, tag in enumerate(tags)])
    got = {r.url: r.title for r in extract_pages(pages).collect()}
    assert got == {str(i): title for i, title in enumerate(tags.values())}


def test_posting_is_no_column_and_tags_are_cut_once(spark):
    """Every expression that reads a VARIANT column copies all of it, and a tag was cut once for each attribute."""
    page = crawl(spark, ("https://x/1", "", 200, ""))
    plan = extract_pages(page)._jdf.queryExecution().optimizedPlan()
    nodes, kinds = [plan], []
    while nodes:
        node = nodes.pop()
        children, output = node.children(), node.output()
        nodes.extend(children.apply(i) for i in range(children.size()))
        kinds.extend(output.apply(i).dataType().simpleString() for i in range(output.size()))
    assert kinds and not [k for k in kinds if "variant" in k]
    tag = F.concat(F.lit("<meta name=x content="), F.col("id"), F.lit(">"))
    tags = spark.range(1).select(meta_attributes(F.array(tag)).alias("metas"))
    cuts = tags._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(")
    assert cuts == 2


def test_script_bodies(spark):
    pages = [
        "<script type='application/ld+json'>a < b </scrip </script x </SCRIPT\n>rest</script>",
        "<script type='application/ld+json'></script>",
        "<script type='application/ld+json'>open </script",
        "<script type='application/ld+json'>ends\n",
    ]
    assert apply(spark, jsonld_scripts, pages) == [["a < b </scrip </script x "], [""], ["open </script"], ["ends\n"]]
    # a long body takes no stack
    body = "<" * 200_000
    assert apply(spark, jsonld_scripts, [f"<script type='application/ld+json'>{body}</script>"]) == [[body]]
