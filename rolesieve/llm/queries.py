"""The training-data operators over the given tables, one query each, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.llm import ann, bpe, exact_dedup, hard_negatives, langid, licenses, line_dedup, merkle, minhash, mixing, sharding, url_filter, warc

#: Where the files of public tokenizers lie on every machine; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, label): pages whose url ends its path with the number of a labelled document; toxic ones are to block."""
    number = F.regexp_extract("url", r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", 1)
    pages = _table(spark, sf_dir, "pages").select("url", number.try_cast("long").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return pages.join(labels, "doc_id").select("url", "label")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.fit(labelled_urls(spark, sf_dir)), RULES)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(_table(spark, sf_dir, "documents"), licenses.fit(spark))
    return scanned.select("doc_id", "licenses", "n_paragraphs", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents")).drop("node")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))), f"{TOKENIZERS}/piece_bpe_32k.model")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    marked = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    return langid.predict(marked, language_model(docs), keep=("doc_id", "held_out"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_nearest": op3_nearest,
    "op4_warc": op4_warc,
    "op5_bpe": op5_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_near_dedup": op7_near_dedup,
    "op8_language": op8_language,
    "op9_source_mix": op9_source_mix,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents
        ), groups AS (
            SELECT normal, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY normal
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256
        FROM texts JOIN groups USING (normal)
    """,
    "op4_warc": r"""
        WITH bodies AS (
            SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
            FROM pages
        ), hashed AS (SELECT *, sha1(body) AS hex FROM bodies)
        SELECT page_id, strlen(body) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4)::INT)) & 31)::INT, 1)), '')
                AS payload_digest,
            CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> response THEN response END AS refers_to
        FROM hashed
    """,
    "op11_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), repeated AS (
            SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE fields AS (
            SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                    lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS inverted,
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
            FROM documents
        ), told AS (
            SELECT doc_id, lang, inverted,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(lowered) || ':' || lowered, '-') AS changed
            FROM fields
        ), leaves AS (
            SELECT doc_id, lang, sha256(head || body) AS leaf,
                sha256(head || CASE WHEN xor(inverted, 4294967295) % 3 = 0 THEN changed ELSE body END) AS claimed
            FROM told
        ), placed AS (
            SELECT *, coalesce('=' || lang, '-') AS tree,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                count(*) OVER (PARTITION BY lang) AS width
            FROM leaves
        ), levels AS (
            SELECT tree, 0 AS level, idx, width, leaf AS hash FROM placed
            UNION ALL
            SELECT tree, level + 1, idx // 8, (max(width) + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx))
            FROM levels WHERE width > 1 GROUP BY tree, level, idx // 8
        ), tops AS (
            SELECT tree, hash AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, count(*) OVER () AS width
            FROM levels WHERE width = 1
        ), above AS (
            SELECT 0 AS level, rank AS idx, width, subroot AS hash FROM tops
            UNION ALL
            SELECT level + 1, idx // 8, (max(width) + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx))
            FROM above WHERE width > 1 GROUP BY level, idx // 8
        ), nodes AS (
            SELECT tree, level, idx, width, hash FROM levels
            UNION ALL SELECT '^', level, idx, width, hash FROM above
        ), climb AS (
            SELECT row_number() OVER () AS id, doc_id, leaf, tree AS home, tree, 0 AS level, idx, width, claimed AS folded, '' AS proof
            FROM placed
            UNION ALL
            SELECT c.id, c.doc_id, c.leaf, c.home, coalesce(any_value(t.up), any_value(c.tree)),
                coalesce(any_value(t.level), any_value(c.level) + 1), coalesce(any_value(t.rank), any_value(c.idx) // 8),
                coalesce(any_value(t.width), (any_value(c.width) + 7) // 8),
                coalesce(sha256(string_agg(CASE WHEN n.idx = c.idx THEN c.folded ELSE n.hash END, '' ORDER BY n.idx)), any_value(c.folded)),
                any_value(c.proof) || coalesce(string_agg(n.hash, '' ORDER BY n.idx) FILTER (n.idx <> c.idx), '')
            FROM climb c
            LEFT JOIN nodes n ON c.width > 1 AND n.tree = c.tree AND n.level = c.level AND n.idx // 8 = c.idx // 8
            LEFT JOIN (SELECT '^' AS up, 0 AS level, * FROM tops) t ON c.width = 1 AND t.tree = c.tree
            WHERE c.width > 1 OR c.tree <> '^'
            GROUP BY c.id, c.doc_id, c.leaf, c.home
        ), root AS (SELECT hash AS root FROM above WHERE width = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM climb JOIN tops ON tops.tree = climb.home CROSS JOIN root WHERE climb.tree = '^' AND climb.width = 1
    """,
    "op13_hard_negatives": """
        WITH taken AS (
            SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same,
                list_dot_product(a.v, b.v)::BIGINT AS score
            FROM taken a JOIN taken b ON a.uid <> b.uid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id,
            (row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id, n.uid))::INTEGER AS rank,
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
            AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5
    """,
}
