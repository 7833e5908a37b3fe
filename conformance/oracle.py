"""DuckDB SQL that says what each query must return, written from the semantics, not from the library."""

from __future__ import annotations

from conformance.fx import (
    AS_OF,
    CHECKED,
    EARLIER_FROM,
    EARLIER_TO,
    FX_DUCKDB,
    OVERALL,
    PER_QUERY,
    URL_PREFIX,
)
from conformance.lists import (
    APPLY_SIGNALS,
    ATS_DOMAINS,
    CATEGORY_KEYWORDS,
    CLOSED_SIGNALS,
    NEGATIVE_KEYWORDS,
    TRACK_KEYWORDS,
    TRACK_QUERY_TEMPLATES,
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kw(keyword: str, column: str) -> str:
    """Keyword test: substring for phrases, otherwise whole word with Unicode letters and numbers."""
    if " " in keyword:
        return f"contains({column}, {quote(keyword)})"
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_]){keyword}($|[^\p{{L}}\p{{N}}_])')"


def category_case(column: str, registry: dict[str, list[str]] = CATEGORY_KEYWORDS) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(kw(k, column) for k in keywords)} THEN {quote(category)}"
        for category, keywords in registry.items()
    )
    return f"CASE {whens} ELSE 'other' END"


def score_sum(track: str, title: str, description: str, registry=TRACK_KEYWORDS, negative=NEGATIVE_KEYWORDS) -> str:
    terms = []
    for strength, (high, low) in {"strong": (10, 5), "weak": (3, 1)}.items():
        for k in registry[track][strength]:
            terms.append(f"CASE WHEN {kw(k, title)} THEN {high} WHEN {kw(k, description)} THEN {low} ELSE 0 END")
    for k in negative:
        both = f"({title} || ' ' || {description})"
        terms.append(f"CASE WHEN {kw(k, both)} THEN -3 ELSE 0 END")
    return f"greatest(0, {' + '.join(terms)})::INTEGER"


def verdict_status(code: str, html: str) -> str:
    closed = " OR ".join(f"contains(lower({html}), {quote(s)})" for s in CLOSED_SIGNALS)
    return (
        f"CASE WHEN {code} IN (404, 410) THEN 'inactive' WHEN {code} = 200 AND ({closed}) THEN 'inactive' "
        f"WHEN {code} = 200 THEN 'active' ELSE 'unknown' END"
    )


def closed_case(html: str) -> str:
    return "CASE " + " ".join(
        f"WHEN contains(lower({html}), {quote(s)}) THEN {quote(s)}" for s in CLOSED_SIGNALS
    ) + " END"


def apply_test(html: str) -> str:
    return "(" + " OR ".join(f"contains(lower({html}), {quote(s)})" for s in APPLY_SIGNALS) + ")"


def verdict_reason(code: str, html: str) -> str:
    return (
        f"CASE WHEN {code} IN (401, 403, 429) THEN 'HTTP ' || {code} || ' — page blocked' "
        f"WHEN {code} >= 500 THEN 'HTTP ' || {code} || ' server error' "
        f"WHEN {code} <> 200 THEN 'HTTP ' || {code} "
        f"WHEN {closed_case(html)} IS NOT NULL THEN 'closed signal: ''' || {closed_case(html)} || '''' "
        f"WHEN {apply_test(html)} THEN 'apply button detected' ELSE 'no closed signals found' END"
    )


def error_or(error: str, status: str, reason: str) -> tuple[str, str]:
    return (
        f"CASE WHEN {error} <> '' THEN 'unknown' ELSE {status} END",
        f"CASE WHEN {error} = 'timeout' THEN 'request timed out' "
        f"WHEN {error} <> '' THEN 'request failed: ' || {error} ELSE {reason} END",
    )


def digest(title: str, company: str, url: str) -> str:
    return f"sha256(concat_ws(chr(0), lower(trim({title})), lower(trim({company})), lower(trim({url}))))"


EARLIER = f"ordered_on >= DATE '{EARLIER_FROM}' AND ordered_on < DATE '{EARLIER_TO}'"

# Posting records, their hash, and the lower-case texts keywords are searched in.
P = f"""
WITH fx AS ({FX_DUCKDB}),
p AS (
 SELECT * REPLACE (trim(title) AS title, trim(company) AS company, trim(location) AS location),
  contains(lower(location), 'remote') AS is_remote,
  {digest('title', 'company', 'posting_url')} AS hash,
  lower(trim(title)) AS t, lower(description) AS d, lower(trim(title) || ' ' || description) AS td
 FROM fx
),
seen AS (SELECT DISTINCT hash FROM p WHERE {EARLIER}),
target AS (SELECT DISTINCT hash FROM p WHERE {EARLIER})
"""

# What each page holds, by construction of the pages.
PAGES = f"""
WITH fx AS ({FX_DUCKDB}),
readable AS (
 SELECT seq AS k, trim(title) AS t, trim(company) AS c, trim(location) AS l, description AS d, date_posted AS dp,
  seq % 8 AS shape, title AS raw_title, status_code, error, html AS body, ordered_on FROM fx
),
ld AS (
 SELECT k, '{URL_PREFIX}p/' || k AS url,
  CASE WHEN shape <= 5 THEN t WHEN shape = 6 THEN t || ' & Co' ELSE '' END AS title,
  CASE WHEN shape <= 6 THEN c ELSE '' END AS company,
  CASE WHEN shape = 5 THEN 'Remote' WHEN shape <= 4 THEN l ELSE '' END AS location,
  CASE WHEN shape <= 6 THEN d ELSE '' END AS description,
  CASE WHEN shape <= 5 THEN dp END AS date_posted,
  CASE WHEN shape <= 5 AND dp IS NOT NULL THEN 'exact' ELSE 'unknown' END AS date_posted_confidence,
  CASE WHEN shape <= 5 AND k % 2 = 1 THEN 'https://apply.example.com/' || k END AS apply_url,
  CASE WHEN shape <= 5 THEN 'INTERN' ELSE '' END AS employment_type,
  status_code, error, body, raw_title, d AS raw_description, t, c, ordered_on
 FROM readable
),
-- all postings in a page's blocks; every eighth page has two more
found AS (
 SELECT k, url, 0 AS pos, title, description, company, location, date_posted, date_posted_confidence, apply_url,
  employment_type FROM ld WHERE k % 8 <= 5
 UNION ALL
 SELECT k, url, 1, 'Second ' || k, '', 'Text Co ' || k, 'Lyon, France', DATE '2024-01-31', 'exact', NULL, ''
 FROM ld WHERE k % 8 = 2
 UNION ALL
 SELECT k, url, 2, 'Third ' || k, '', '', 'Paris, FR', NULL, 'unknown', 'https://apply.example.com/third', 'FULL_TIME'
 FROM ld WHERE k % 8 = 2
),
visits AS (
 SELECT k AS seq, 0 AS page, * FROM ld
 UNION ALL
 SELECT k AS seq, 1 AS page, * REPLACE ('{URL_PREFIX}P/' || k AS url) FROM ld WHERE k % 10 = 6
),
marked AS (SELECT *, error <> '' OR status_code BETWEEN 400 AND 599 AS blocked FROM visits),
extracted AS (
 SELECT * REPLACE (
  CASE WHEN blocked THEN '' ELSE title END AS title, CASE WHEN blocked THEN '' ELSE company END AS company,
  CASE WHEN blocked THEN '' ELSE location END AS location,
  CASE WHEN blocked THEN '' ELSE description END AS description,
  CASE WHEN NOT blocked THEN date_posted END AS date_posted,
  CASE WHEN blocked THEN 'unknown' ELSE date_posted_confidence END AS date_posted_confidence,
  -- the page's own URL under /P/ differs from the one it names
  CASE WHEN NOT blocked THEN coalesce(apply_url,
   CASE WHEN page = 1 AND k % 2 = 0 AND k % 8 <= 5 THEN '{URL_PREFIX}p/' || k || '/' END) END AS apply_url,
  CASE WHEN blocked THEN '' ELSE employment_type END AS employment_type)
 FROM marked
),
built AS (
 SELECT ((seq % 40) << 43) + (page::BIGINT << 30) + CAST(floor(seq / 40.0) AS BIGINT) AS order_key, url AS posting_url,
  coalesce(nullif(title, ''), trim(raw_title)) AS title,
  CASE WHEN company <> '' THEN company WHEN fallback THEN 'Unknown' ELSE '' END AS company,
  CASE WHEN location <> '' THEN location WHEN fallback THEN 'Unknown' ELSE '' END AS location,
  CASE WHEN description <> '' THEN description WHEN fallback THEN raw_description ELSE '' END AS description,
  apply_url, date_posted, date_posted_confidence, blocked, status_code, error, body
 FROM (SELECT *, blocked OR (title = '' AND company = '' AND description = '') AS fallback FROM extracted)
),
run_seen AS (
 SELECT DISTINCT {digest('t', 'c', f"'{URL_PREFIX}p/' || k")} AS hash FROM ld WHERE {EARLIER}
)
"""

# The text of each block, put together piece by piece.
BLOCKS = f"""{PAGES},
pieces AS (
 SELECT seq AS k, '{URL_PREFIX}p/' || seq AS url, strftime(date_posted, '%Y-%m-%d') AS day, contains(location, ', ') AS two, *
 FROM fx WHERE seq % 8 <= 5
),
bodies AS (
 SELECT k, url,
  '{{"@context":"https://schema.org","@type":' || CASE k % 16 WHEN 4 THEN '[["JobPosting"],["Thing"]]' WHEN 12 THEN
   '["JobPosting","Thing"]' WHEN 5 THEN '"schema:JobPosting"' WHEN 13 THEN '"schema:JobPosting"' ELSE '"JobPosting"' END
  || ',"title":' || to_json(title) || ',"description":' || to_json(description)
  || coalesce(',"datePosted":"' || CASE k % 4 WHEN 0 THEN day WHEN 1 THEN day || 'T09:00:00Z'
   WHEN 2 THEN day || 'T23:30:00.250-05:00' ELSE strftime(date_posted, '%Y%m%d') END || '"', '')
  || CASE WHEN k % 16 = 0 THEN ',"baseSalary":NaN,"bounds":[-Infinity,Infinity]' ELSE '' END
  || ',"employmentType":"INTERN","hiringOrganization":{{' || coalesce('"name":' || to_json(nullif(company, '')), '') || '}}'
  || ',"jobLocation":' || CASE WHEN k % 3 = 0 THEN '[' ELSE '' END || '{{"@type":"Place","address":{{' ||
   CASE WHEN two THEN '"addressLocality":' || to_json(split_part(location, ', ', 1)) || ',"addressRegion":'
    || to_json(split_part(location, ', ', 2)) || ',"addressCountry":"US"'
   ELSE coalesce('"addressCountry":' || to_json(nullif(location, '')), '') END
  || '}}}}' || CASE WHEN k % 3 = 0 THEN ']' ELSE '' END
  || ',"url":"' || CASE WHEN k % 2 = 0 THEN '{URL_PREFIX}p/' || k || '/' ELSE 'https://apply.example.com/' || k END || '"'
  || CASE WHEN k % 8 = 5 THEN ',"jobLocationType":"TELECOMMUTE"' ELSE '' END || '}}' AS body, trim(title) AS title
 FROM pieces
),
blocks AS (
 SELECT k, url, CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END AS blk, CASE k % 8
  WHEN 1 THEN '{{"@graph":[{{"@type":"WebPage","name":"Careers"}},' || body || ']}}'
  WHEN 2 THEN '[{{"@type":"BreadcrumbList"}},[' || body || ',{{"@type":"JobPosting","title":"Second ' || k
   || '","hiringOrganization":" Text Co ' || k || '","jobLocation":["Lyon, France"],"datePosted":"2024-W05-3"}}],'
   || '{{"@type":"http://schema.org/JobPosting","title":"Third ' || k || '","jobLocation":{{"address":{{"addressLocality":'
   || '"Paris","addressCountry":"FR"}}}},"datePosted":"soon","employmentType":"FULL_TIME",'
   || '"url":"https://apply.example.com/third"}}]'
  ELSE body END AS raw, CASE WHEN k % 8 IN (1, 2) THEN '' ELSE title END AS title FROM bodies
 UNION ALL
 SELECT k, url, 0, '{{ not: json }}', '' FROM bodies WHERE k % 8 = 3
)
"""

EXTRACTED = (
    "url, title, company, location, description, date_posted, date_posted_confidence, apply_url, employment_type, "
    "blocked"
)
# Domains in the order they are listed, each once per location and before the query without a domain.
_DOMAIN_ROWS = ", ".join(
    f"({i}, {quote(' site:' + d)})" for i, d in enumerate(d for listed in ATS_DOMAINS.values() for d in listed)
)
_N_DOMAINS = sum(len(listed) for listed in ATS_DOMAINS.values())

CAMPAIGNS = """
WITH campaigns AS (
 SELECT c_custkey AS campaign_id,
  CASE c_custkey % 5 WHEN 0 THEN 'cyber' WHEN 1 THEN 'it' WHEN 2 THEN 'swe' WHEN 3 THEN 'data' ELSE 'all' END AS track,
  CASE WHEN c_custkey % 4 IN (0, 1) THEN lower(c_mktsegment) || ' python' END AS keywords,
  CASE WHEN c_custkey % 4 IN (0, 2) THEN 'data' END AS categories,
  CASE WHEN c_custkey % 3 = 0 THEN [''] ELSE [' ' || n_name, ' Remote'] END AS places
 FROM customer JOIN nation ON c_nationkey = n_nationkey
)
"""
_TEMPLATE_CASE = "CASE track " + " ".join(
    f"WHEN {quote(t)} THEN {quote(q)}" for t, q in TRACK_QUERY_TEMPLATES.items()
) + " END"

SEARCH = f"""
WITH fx AS ({FX_DUCKDB}),
search AS (
 SELECT seq % 40 AS query_rank, 0::BIGINT AS page, CAST(floor(seq / 40.0) AS BIGINT) AS pos,
  CASE WHEN seq % 29 = 0 THEN '' ELSE posting_url END AS url, title, description AS snippet
 FROM fx
),
capped AS (
 SELECT * FROM search QUALIFY row_number() OVER (PARTITION BY query_rank ORDER BY page, pos) <= {PER_QUERY}
)
"""
_FIRST_URL = "QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_rank, page, pos) = 1"

EXPORT = """
 strftime({day}, '%Y-%m-%d') AS "Added At", {category} AS "Category", title AS "Title", company AS "Company",
 location AS "Location", coalesce(strftime(date_posted, '%Y-%m-%d'), '') AS "Date Posted",
 date_posted_confidence AS "Date Confidence", {apply} AS "Apply URL", posting_url AS "Posting URL",
 {source} AS "Source", hash AS "Hash", {status} AS "Status", {reason} AS "Status Reason", {label} AS "Track Match"
"""


def export_columns(day: str, **values: str) -> str:
    empty = {n: "''" for n in ("category", "apply", "source", "reason", "label")} | {"status": "'unknown'"}
    return EXPORT.format(day=f"DATE '{day}'", **(empty | values))


def label_of(title: str, description: str, min_score: int = 3) -> str:
    parts = ", ".join(
        f"CASE WHEN {score_sum(t, title, description)} >= {min_score} THEN {quote(t)} END" for t in TRACK_KEYWORDS
    )
    return f"concat_ws('|', {parts})"


_STATUS, _REASON = error_or("error", verdict_status("status_code", "html"), verdict_reason("status_code", "html"))
_RUN_STATUS, _RUN_REASON = error_or(
    "error", verdict_status("status_code", "body"), verdict_reason("status_code", "body")
)

RECENT = (
    f"NOT (date_posted_confidence = 'exact' AND date_posted IS NOT NULL AND date_posted < DATE '{AS_OF}' - {{days}})"
)
PLACED = "CASE WHEN is_remote THEN {remote} ELSE {allowed} END"
TWO_PLACES = "(contains(lower(location), 'new york') OR contains(lower(location), 'austin'))"

# The run: dates, places, first of each identity, not seen before; then category, track and activity.
RUN = f"""{PAGES},
located AS (
 SELECT *, contains(lower(location), 'remote') AS is_remote, {digest('title', 'company', 'posting_url')} AS hash
 FROM built
),
reached AS (
 SELECT * FROM located WHERE {RECENT.format(days=2000)}
  AND (blocked OR location = 'Unknown' OR {PLACED.format(remote='TRUE', allowed=TWO_PLACES)})
),
fresh AS (
 SELECT * FROM (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY hash ORDER BY order_key) = 1)
 WHERE hash NOT IN (SELECT hash FROM run_seen)
),
labelled AS (
 SELECT *, {category_case("lower(title || ' ' || description)")} AS category,
  {label_of('lower(title)', 'lower(description)')} AS track_match,
  {score_sum('swe', 'lower(title)', 'lower(description)')} AS swe_score
 FROM fresh
),
"""
RUN_COLUMNS = """order_key AS seq, title, company, location, description, posting_url, apply_url, date_posted,
 date_posted_confidence, 'brave' AS source, category, is_remote, active_status, active_reason, track_match, hash"""

_SELECTED = f"""{RUN}
checked AS (
 SELECT *, row_number() OVER (ORDER BY order_key) <= {CHECKED} AS checked,
  {_RUN_STATUS} AS status, {_RUN_REASON} AS reason
 FROM labelled WHERE category IN ('software', 'data', 'other') AND swe_score >= 3
),
finished AS (
 SELECT *, CASE WHEN checked THEN status ELSE 'unknown' END AS active_status,
  CASE WHEN checked THEN reason ELSE '' END AS active_reason
 FROM checked
)
SELECT {RUN_COLUMNS} FROM finished
WHERE active_status <> 'inactive' AND NOT (checked AND active_status = 'unknown')
"""

# documents: words that do occur there, with single words, phrases and accents.
DOC_CATEGORIES = {"french": ["des", "été", "de la"], "german": ["der", "und"], "english": ["the", "is the"]}
DOC_TRACKS = {
    "romance": {"strong": ["de la", "des", "que"], "weak": ["el", "la", "en"]},
    "germanic": {"strong": ["of the", "und", "the"], "weak": ["nicht", "and", "that"]},
}

PHRASE_LETTERS = "adeilnorst"

# Title of a raw page with its character references decoded; the ampersand last, so nothing is decoded twice.
# A title cut short may end in a reference without its semicolon.
TITLE_TEXT = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"
TITLE_TEXT = rf"regexp_replace({TITLE_TEXT}, '&(amp|lt|gt|quot)$', '&\1;')"
for _reference, _character in {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&#x27;": "''", "&apos;": "''", "&amp;": "&",
}.items():
    TITLE_TEXT = f"replace({TITLE_TEXT}, '{_reference}', '{_character}')"
TITLE_TEXT = f"trim({TITLE_TEXT})"

SQL: dict[str, str] = {
    # sources
    "scan_crawl": f"{PAGES} SELECT url, status_code, error, blocked FROM marked",
    "ingest_google_results": f"""{SEARCH} SELECT query_rank, pos // 10 AS page, pos % 10 AS pos, url,
        trim(title) AS title, snippet FROM (SELECT * REPLACE (
         row_number() OVER (PARTITION BY query_rank ORDER BY pos) - 1 AS pos) FROM search)""",
    "ingest_brave_results": f"""{SEARCH} SELECT query_rank, pos // 20 AS page, pos % 20 AS pos, url,
        trim(title) AS title, snippet FROM (SELECT * REPLACE (
         row_number() OVER (PARTITION BY query_rank ORDER BY pos) - 1 AS pos) FROM search)""",
    "load_seen_hashes": f"{P} SELECT DISTINCT hash FROM p",
    "scan_target_hashes": f"{P} SELECT hash FROM p",
    # search
    "expand_search_queries": f"""{CAMPAIGNS},
        bases AS (SELECT campaign_id, concat_ws(' ', keywords, categories,
          CASE WHEN keywords IS NULL THEN 'internship intern' END) AS base, places FROM campaigns),
        generic AS (SELECT campaign_id, base || unnest(places) AS query, unnest(range(len(places))) AS place,
          len(places) AS n FROM bases),
        sites AS (SELECT * FROM (VALUES {_DOMAIN_ROWS}, ({_N_DOMAINS}, '')) AS s(site_rank, site))
        SELECT campaign_id, CAST(site_rank * n + place AS BIGINT) AS query_rank, query || site AS query
        FROM generic, sites""",
    "track_query_terms": f"""{CAMPAIGNS} SELECT campaign_id, track,
        coalesce(keywords, {_TEMPLATE_CASE}, '') AS keywords FROM campaigns""",
    "freshness_bucket": f"""WITH fx AS ({FX_DUCKDB}),
        aged AS (SELECT seq, CAST(date_diff('day', date_posted, DATE '{AS_OF}') AS INTEGER) AS days FROM fx)
        SELECT seq, days, CASE WHEN days IS NULL OR days > 365 THEN NULL WHEN days <= 1 THEN 'pd' WHEN days <= 7
         THEN 'pw' WHEN days <= 30 THEN 'pm' ELSE 'py' END AS freshness FROM aged""",
    "cap_per_query": f"{SEARCH} SELECT * FROM capped",
    "dedup_by_url": f"{SEARCH} SELECT * FROM search WHERE url <> '' {_FIRST_URL}",
    "cap_results": f"{SEARCH} SELECT * FROM search ORDER BY query_rank, page, pos LIMIT {OVERALL}",
    "first_in_order": f"""{SEARCH} SELECT * FROM search ORDER BY query_rank, page, pos
        LIMIT (SELECT count(*) // 2 FROM search)""",
    "merge_search_results_campaigns": f"""{SEARCH}, shared AS (SELECT *, pos % 7 AS campaign_id FROM search),
        firsts AS (SELECT * FROM shared
         QUALIFY row_number() OVER (PARTITION BY campaign_id, query_rank ORDER BY page, pos) <= {PER_QUERY}),
        distinct_urls AS (SELECT * FROM firsts WHERE url <> ''
         QUALIFY row_number() OVER (PARTITION BY campaign_id, url ORDER BY query_rank, page, pos) = 1)
        SELECT * FROM distinct_urls
        QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY query_rank, page, pos) <= {PER_QUERY}""",
    "merge_search_results": f"""{SEARCH} SELECT * FROM (SELECT * FROM capped WHERE url <> '' {_FIRST_URL})
        ORDER BY query_rank, page, pos LIMIT {PER_QUERY}""",
    # extraction
    "jsonld_blocks": f"{BLOCKS} SELECT url, CAST(blk AS INTEGER) AS blk, raw FROM blocks",
    "jsonld_parse": f"""{BLOCKS} SELECT url, CAST(blk AS INTEGER) AS blk, raw <> '{{ not: json }}' AS parsed, title
        FROM blocks""",
    "is_job_posting_type": f"""{PAGES} SELECT url, CAST(CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END AS INTEGER) AS blk,
        k % 8 NOT IN (1, 2) AS is_posting FROM ld WHERE k % 8 <= 5""",
    "jsonld_walk": f"""{PAGES} SELECT url, CAST(CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END AS INTEGER) AS blk,
        CAST(pos AS INTEGER) AS pos, title FROM found""",
    "first_job_posting": f"{PAGES} SELECT url, title FROM found WHERE pos = 0",
    "field_text": f"{PAGES} SELECT url, title, description FROM found",
    "parse_company": f"{PAGES} SELECT url, company FROM found",
    "parse_location": f"{PAGES} SELECT url, location FROM found",
    "parse_date": f"{PAGES} SELECT url, date_posted, date_posted_confidence FROM found",
    "parse_apply_url": f"{PAGES} SELECT url, apply_url FROM found",
    "parse_employment_type": f"{PAGES} SELECT url, employment_type FROM found",
    "meta_fallback": rf"""SELECT url, {TITLE_TEXT} AS title, '' AS company, '' AS description FROM pages""",
    "meta_fallback_open_graph": f"""{PAGES} SELECT url, CASE WHEN k % 8 = 6 THEN title ELSE '' END AS title,
        CASE WHEN k % 8 = 6 THEN company ELSE '' END AS company,
        CASE WHEN k % 8 = 6 THEN description ELSE '' END AS description FROM ld""",
    "extract_pages": f"{PAGES} SELECT {EXTRACTED} FROM extracted",
    "extract_new_pages": f"{PAGES} SELECT {EXTRACTED} FROM extracted",
    "extract_pages_raw": rf"""SELECT url, {TITLE_TEXT} AS title, '' AS company, '' AS location, '' AS description, CAST(NULL AS DATE) AS date_posted,
        'unknown' AS date_posted_confidence, CAST(NULL AS VARCHAR) AS apply_url, '' AS employment_type,
        FALSE AS blocked FROM pages""",
    # postings
    "make_postings": f"""{PAGES} SELECT order_key AS seq, title, company, location, description, posting_url,
        apply_url, date_posted, date_posted_confidence, 'brave' AS source, blocked,
        contains(lower(location), 'remote') AS is_remote FROM built""",
    "normalise_posting": f"{P} SELECT seq, title, company, location FROM p",
    "infer_remote": f"{P} SELECT seq, location, is_remote FROM p",
    "export_rows": f"{P} SELECT {export_columns(AS_OF)} FROM p",
    # filters
    "filter_recent": f"{P} SELECT seq, date_posted, date_posted_confidence FROM p WHERE {RECENT.format(days=365)}",
    "filter_location": f"""{P} SELECT seq, location, is_remote FROM p
        WHERE {PLACED.format(remote='FALSE', allowed=TWO_PLACES)}""",
    "filter_location_known": f"""{PAGES} SELECT posting_url, location, blocked FROM
        (SELECT *, contains(lower(location), 'remote') AS is_remote FROM built)
        WHERE blocked OR location = 'Unknown' OR {PLACED.format(remote='TRUE', allowed=TWO_PLACES)}""",
    "filter_category": f"""{P} SELECT * FROM (SELECT seq, title, {category_case('td')} AS category FROM p)
        WHERE category IN ('data', 'software')""",
    "filter_track": f"{P} SELECT seq, title, description FROM p WHERE {score_sum('cyber', 't', 'd')} >= 3",
    "filter_active": f"""{P}, ranked AS (SELECT seq, row_number() OVER (ORDER BY seq) <= {CHECKED} AS checked,
        {_STATUS} AS status FROM p)
        SELECT seq, checked, CASE WHEN checked THEN status ELSE 'unknown' END AS active_status FROM ranked
        WHERE NOT checked OR status = 'active'""",
    # dedup
    "posting_hash": f"{P} SELECT seq, hash FROM p",
    "dedup_first": f"""{P} SELECT seq, title, company, posting_url, hash FROM p
        QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) = 1""",
    "dedup_unseen": f"{P} SELECT seq, hash FROM p WHERE hash NOT IN (SELECT hash FROM seen)",
    "seen_count": f"{P} SELECT count(DISTINCT hash) AS seen_count FROM p",
    "dedup_unseen_state": f"{P} SELECT seq, hash FROM p WHERE hash NOT IN (SELECT hash FROM seen)",
    "compact_seen": f"{P} SELECT DISTINCT hash FROM p",
    "seen_count_state": f"{P} SELECT count(DISTINCT hash) AS seen_count FROM p",
    "update_seen": f"""{P} SELECT hash FROM seen UNION
        SELECT hash FROM p WHERE {RECENT.format(days=365)}""",
    "new_hashes": f"{P} SELECT DISTINCT hash FROM p WHERE hash NOT IN (SELECT hash FROM seen)",
    # classification
    "kw_match": f"""SELECT doc_id, {kw('the', 'lower(text)')} AS has_the, {kw('des', 'lower(text)')} AS has_des,
        {kw('été', 'lower(text)')} AS has_ete, {kw('of the', 'lower(text)')} AS has_of_the FROM documents""",
    "kw_match_postings": f"""{P} SELECT seq, {kw('data', 'td')} AS has_data, {kw('it analyst', 'td')} AS has_it_analyst,
        {kw('full-stack', 'td')} AS has_full_stack FROM p""",
    "kw_match_many": f"""WITH letters AS (SELECT unnest(string_split('{PHRASE_LETTERS}', '')) AS c),
        pieces AS (SELECT a.c || b.c AS piece FROM letters a, letters b),
        phrases AS (SELECT a.piece || ' ' || b.piece AS phrase FROM pieces a, pieces b)
        SELECT doc_id, CAST(count(phrase) AS INTEGER) AS n_phrases, min(phrase) AS first_phrase
        FROM documents LEFT JOIN phrases ON contains(lower(text), phrase) GROUP BY doc_id""",
    "categorize": f"{P} SELECT seq, title, {category_case('td')} AS category FROM p",
    "categorize_documents": f"""SELECT doc_id, {category_case("lower(' ' || text)", DOC_CATEGORIES)} AS category
        FROM documents""",
    "score_track": f"{P} SELECT seq, {score_sum('swe', 't', 'd')} AS score, 1 AS score_all FROM p",
    "score_all_tracks": f"""{P} SELECT seq, {', '.join(f"{score_sum(t, 't', 'd')} AS score_{t}" for t in TRACK_KEYWORDS)}
        FROM p""",
    "score_documents": "SELECT doc_id, " + ", ".join(
        f"{score_sum(t, quote(''), 'lower(text)', DOC_TRACKS)} AS score_{t}" for t in DOC_TRACKS
    ) + " FROM documents",
    "best_tracks": f"{P} SELECT seq, {label_of('t', 'd', 5).replace(quote('|'), quote(','))} AS best_tracks FROM p",
    "track_label": f"{P} SELECT seq, title, {label_of('t', 'd')} AS track_match FROM p",
    # activity
    "active_verdict": f"""{P} SELECT seq, {verdict_status('status_code', 'html')} AS status,
        {verdict_reason('status_code', 'html')} AS reason FROM p""",
    "closed_signal": f"{P} SELECT seq, {closed_case('html')} AS closed_signal FROM p",
    "apply_signal": f"{P} SELECT seq, {apply_test('html')} AS apply_signal FROM p",
    "fetch_error_verdict": f"""{P} SELECT seq, CASE WHEN error <> '' THEN 'unknown' END AS status,
        CASE WHEN error = 'timeout' THEN 'request timed out' WHEN error <> '' THEN 'request failed: ' || error END
        AS reason FROM p""",
    "check_first_n": f"""{P}, ranked AS (SELECT seq, row_number() OVER (ORDER BY seq) <= {CHECKED} AS checked,
        {_STATUS} AS status, {_REASON} AS reason FROM p)
        SELECT seq, checked, CASE WHEN checked THEN status ELSE 'unknown' END AS active_status,
        CASE WHEN checked THEN reason ELSE '' END AS active_reason FROM ranked""",
    # sinks and runs
    "align_target_schema": f"""{P} SELECT {export_columns(EARLIER_TO)} FROM p""",
    "upsert_new_rows": f"""{P}, firsts AS (SELECT * FROM p
        QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) = 1)
        SELECT {export_columns(AS_OF)} FROM firsts WHERE hash NOT IN (SELECT hash FROM target)""",
    "run_pipeline": f"""{RUN} finished AS (SELECT *, 'unknown' AS active_status, '' AS active_reason FROM labelled)
        SELECT {RUN_COLUMNS} FROM finished""",
    "upsert_concurrent": f'{P} SELECT DISTINCT hash AS "Hash" FROM p',
    "run_pipeline_recrawled": f"""{RUN} finished AS (SELECT *, 'unknown' AS active_status, '' AS active_reason
        FROM labelled) SELECT {RUN_COLUMNS} FROM finished""",
    "run_pipeline_selected": _SELECTED,
    "run_pipeline_state": f"{RUN} state AS (SELECT hash FROM fresh) SELECT hash FROM state",
    "execute_run": f"""{RUN} earlier AS (SELECT 1)
        SELECT {export_columns(AS_OF, category='category', apply="coalesce(apply_url, '')", source="'brave'",
        label='track_match')} FROM labelled""",
    "incremental_run": f"""{RUN} earlier AS (SELECT 1)
        SELECT {export_columns(AS_OF, category='category', apply="coalesce(apply_url, '')", source="'brave'",
        label='track_match')} FROM labelled""",
}
SQL["keyed_incremental_run"] = SQL["incremental_run"]
