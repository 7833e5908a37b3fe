"""Spark side of the derived inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance.fx import EARLIER_FROM, EARLIER_TO, FX_TEMPLATE, URL_PREFIX
from rolesieve.operators.postings import export_rows, infer_remote, normalise_posting, with_hash

EARLIER_RUN = dt.date(1998, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    # a given table is one row group, so one task: its narrow rows are dealt before titles and pages are made of them
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return spark.sql(FX_TEMPLATE, orders=orders, **tables)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx`` as posting records."""
    return infer_remote(normalise_posting(fx(spark, sf_dir)))


def _earlier() -> Column:
    return (F.col("ordered_on") >= EARLIER_FROM) & (F.col("ordered_on") < EARLIER_TO)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run has recorded, for queries about seen and unseen rows."""
    return with_hash(postings(spark, sf_dir).filter(_earlier())).select("hash").distinct()


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run has appended."""
    return export_rows(postings(spark, sf_dir).filter(_earlier()), EARLIER_RUN)


def full_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hash(postings(spark, sf_dir)).select("hash").distinct()


def full_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(postings(spark, sf_dir), EARLIER_RUN)


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncapped search results over 40 queries; URLs repeat across queries and some are blank."""
    url = F.when(F.col("seq") % 29 == 0, F.lit("")).otherwise(F.col("posting_url"))
    return fx(spark, sf_dir).select(*_ranks(), url.alias("url"), "title", F.col("description").alias("snippet"))


def campaign_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of seven campaigns in one table; queries, positions and URLs repeat across them."""
    return search(spark, sf_dir).withColumn("campaign_id", F.col("pos") % 7)


def _ranks() -> list[Column]:
    seq = F.col("seq")
    return [
        (seq % 40).alias("query_rank"),
        F.lit(0).cast("bigint").alias("page"),
        F.floor(seq / 40.0).cast("bigint").alias("pos"),
    ]


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search campaign per customer; each list is empty for some."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    return spark.sql(
        """
        SELECT c_custkey AS campaign_id,
         CASE c_custkey % 5 WHEN 0 THEN 'cyber' WHEN 1 THEN 'it' WHEN 2 THEN 'swe' WHEN 3 THEN 'data' ELSE 'all' END
          AS track,
         CASE WHEN c_custkey % 4 IN (0, 1) THEN array(lower(c_mktsegment), 'python') ELSE CAST(array() AS ARRAY<STRING>)
          END AS keywords,
         CASE WHEN c_custkey % 4 IN (0, 2) THEN array('data') ELSE CAST(array() AS ARRAY<STRING>) END AS categories,
         CASE WHEN c_custkey % 3 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(n_name, 'Remote') END AS locations
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        """,
        **tables,
    )


# -- crawled pages -------------------------------------------------------------------------------------


def _page(k: Column) -> Column:
    """A page with the posting of row ``k``, in one of eight shapes."""
    name = lambda c, n: F.nullif(c, F.lit("")).alias(n)
    location, has_comma = F.col("location"), F.contains(F.col("location"), F.lit(","))
    address = F.struct(
        F.when(has_comma, F.split_part("location", F.lit(", "), F.lit(1))).alias("addressLocality"),
        F.when(has_comma, F.split_part("location", F.lit(", "), F.lit(2))).alias("addressRegion"),
        F.when(has_comma, F.lit("US")).otherwise(F.nullif(location, F.lit(""))).alias("addressCountry"),
    )
    place = F.struct(F.lit("Place").alias("@type"), address.alias("address"))
    day = F.date_format("date_posted", "yyyy-MM-dd")
    posted = (
        F.when(k % 4 == 0, day)
        .when(k % 4 == 1, F.concat(day, F.lit("T09:00:00Z")))
        .when(k % 4 == 2, F.concat(day, F.lit("T23:30:00.250-05:00")))
        .otherwise(F.date_format("date_posted", "yyyyMMdd"))
    )
    url = F.when(k % 2 == 0, F.concat(F.lit(URL_PREFIX + "p/"), k, F.lit("/"))).otherwise(
        F.concat(F.lit("https://apply.example.com/"), k)
    )

    def posting(kind: Column, *extra: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("https://schema.org").alias("@context"),
                kind.alias("@type"),
                F.col("title").alias("title"),
                F.col("description").alias("description"),
                posted.alias("datePosted"),
                F.lit("INTERN").alias("employmentType"),
                F.struct(name(F.col("company"), "name")).alias("hiringOrganization"),
                F.when(k % 3 == 0, F.array(place)).alias("jobLocationList"),
                F.when(k % 3 != 0, place).alias("jobLocation"),
                url.alias("url"),
                *extra,
            )
        )

    def script(body: Column) -> Column:
        # to_json has no field that is now a list and now an object; the list form gets the real name here.
        named = F.replace(body, F.lit("jobLocationList"), F.lit("jobLocation"))
        return F.concat(F.lit('<script type="application/ld+json">'), named, F.lit("</script>"))

    # numbers that JSON does not have but parsers accept, and types in lists of lists
    odd = F.lit('"baseSalary":NaN,"bounds":[-Infinity,Infinity],"employmentType"')
    whole = posting(F.lit("JobPosting"))
    plain = F.when(k % 16 == 0, F.replace(whole, F.lit('"employmentType"'), odd)).otherwise(whole)
    remote = posting(F.lit("schema:JobPosting"), F.lit("TELECOMMUTE").alias("jobLocationType"))
    nested = posting(F.array(F.array(F.lit("JobPosting")), F.array(F.lit("Thing"))))
    listed = F.when(k % 16 == 4, nested).otherwise(posting(F.array(F.lit("JobPosting"), F.lit("Thing"))))
    # two more postings: company and place as text, an ISO week; a foreign country, no company, no date
    second = F.concat(
        F.lit('{"@type":"JobPosting","title":"Second '), k, F.lit('","hiringOrganization":" Text Co '), k,
        F.lit('","jobLocation":["Lyon, France"],"datePosted":"2024-W05-3"}'),
    )
    third = F.concat(
        F.lit('{"@type":"http://schema.org/JobPosting","title":"Third '), k,
        F.lit('","jobLocation":{"address":{"addressLocality":"Paris","addressCountry":"FR"}},"datePosted":"soon"'),
        F.lit(',"employmentType":"FULL_TIME","url":"https://apply.example.com/third"}'),
    )
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage","name":"Careers"},'), plain, F.lit("]}"))
    array = F.concat(F.lit('[{"@type":"BreadcrumbList"},['), plain, F.lit(","), second, F.lit("],"), third, F.lit("]"))
    broken = F.concat(F.lit('<script type="application/ld+json">{ not: json }</script>'), script(plain))
    og = F.concat(
        F.lit("<head><title>Careers</title><!-- <meta property='og:title' content='old'> -->"),
        F.lit('<meta property="og:title" content="'), F.trim("title"), F.lit(' &amp; Co" />'),
        F.lit("<meta property='og:site_name' content='"), F.col("company"), F.lit("'>"),
        F.lit("<meta property=og:description content=\""), F.col("description"), F.lit('"></head>'),
    )
    shape = k % 8
    return (
        F.when(shape == 0, script(plain))
        .when(shape == 1, script(graph))
        .when(shape == 2, script(array))
        .when(shape == 3, broken)
        .when(shape == 4, script(listed))
        .when(shape == 5, script(remote))
        .when(shape == 6, og)
        .otherwise("<html><body>Nothing to read here</body></html>")
    )


def ld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One readable page per ``fx`` row."""
    k = F.col("seq")
    url = F.concat(F.lit(URL_PREFIX + "p/"), k)
    return fx(spark, sf_dir).select(
        url.alias("url"), F.lit(200).alias("status_code"), _page(k).alias("html"), url.alias("final_url"),
        F.lit("").alias("error"),
    )


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every row with status and error; every tenth is crawled under /P/ as well, found on a second page."""
    k = F.col("seq")
    visits = F.array(
        F.struct(F.lit(0).cast("bigint").alias("page"), F.lit("p/").alias("path")),
        F.when(k % 10 == 6, F.struct(F.lit(1).cast("bigint").alias("page"), F.lit("P/").alias("path"))),
    )
    source = fx(spark, sf_dir).select(
        "seq", "title", "description", "status_code", "error",
        F.concat(_page(k), F.col("html")).alias("html"), F.explode(F.array_compact(visits)).alias("visit"),
    )
    return source.select(
        "seq", "visit.page", F.concat(F.lit(URL_PREFIX), "visit.path", "seq").alias("url"), "title", "description",
        "status_code", "html", "error",
    )


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).select("url", "status_code", "html", F.col("url").alias("final_url"), "error")


def recrawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page visited twice: the first visit found it gone, the second found what ``crawl`` has."""
    pages = crawl(spark, sf_dir)
    first = pages.withColumns({"html": F.lit("<p>Position has been filled</p>"), "status_code": F.lit(200), "error": F.lit("")})
    return first.withColumn("fetched_at", F.lit(1)).unionByName(pages.withColumn("fetched_at", F.lit(2)))


def run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results that point at the crawled pages."""
    rank, _, pos = _ranks()
    return _crawled(spark, sf_dir).select(rank, "page", pos, "url", "title", F.col("description").alias("snippet"))


def run_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes an earlier run recorded for pages it could read."""
    named = postings(spark, sf_dir).filter(_earlier()).withColumn(
        "posting_url", F.concat(F.lit(URL_PREFIX + "p/"), "seq")
    )
    return with_hash(named).select("hash").distinct()


def responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The search results as landed Google and Brave responses, ten and twenty to a page."""

    def bodies(size: int, url: str, snippet: str, wrap) -> DataFrame:
        item = F.struct(
            F.col("pos").alias("pos"),
            F.struct(F.col("url").alias(url), "title", F.col("snippet").alias(snippet)).alias("item"),
        )
        paged = search(spark, sf_dir).withColumn("page", F.floor(F.col("pos") / size).cast("bigint"))
        listed = paged.groupBy("query_rank", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
        return listed.select("query_rank", "page", wrap(F.col("items.item")).alias("response"))

    google = bodies(10, "link", "snippet", lambda items: F.struct(items.alias("items")))
    brave = bodies(
        20, "url", "description", lambda items: F.struct(F.struct(items.alias("results")).alias("web"))
    )
    return google, brave
