"""The registered queries of the operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraprofile.llm import alignment, decontaminate, exact_dedup, fim, html_extract, jaccard_join, packing, quality, secret_scan, token_counts, token_files, url_filter, warc
from terraprofile.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_token_counts")
def token_counts_query(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.prefix_token_counts(docs, tokenizer=public_tokenizers.path(TOKENIZER))
    n = token_counts.n_tokens(F.col("prefix_tokens"))
    text = F.coalesce("text", F.lit(""))
    return counted.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > 1024).alias("over_limit"))


A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op5_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {A_TO_Z}) AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY x)""",
)
def exact_dedup_query(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op6_packing")
def packing_query(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_token_files")
def token_files_query(spark, folder):
    written = token_files.write_token_files(table(spark, folder, "documents"), scratch_path(spark, "token-files"), public_tokenizers.path(TOKENIZER), end_id=0)
    return token_files.read_token_files(spark, written, with_ids=False)


@query(
    "op9_decontaminate",
    f"""
    WITH b AS (SELECT item_id, regexp_extract_all(translate(text, {A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
      FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0),
    widths AS (SELECT DISTINCT width FROM win),
    d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
    pos AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS words
      FROM d, widths, LATERAL (SELECT unnest(range(1, len(w) - width + 2)) AS i) WHERE len(w) >= width),
    hits AS (SELECT doc_id, item_id, i, width FROM pos JOIN win USING (width, words)),
    words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def decontaminate_query(spark, folder):
    found = decontaminate.with_verdict(decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


@query(
    "op10_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS x FROM pages),
    k AS (SELECT page_id, octet_length(x) AS n, sha1(x) AS digest, max(page_id) OVER (PARTITION BY x) AS first FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
      CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
    FROM k""",
)
def warc_query(spark, folder):
    uri = scratch_path(spark, "warc")
    warc.write_warc(warc.with_revisits(table(spark, folder, "pages")), uri)
    # what a response holds is measured on the payload that was read back; a revisit's headers name its own
    back = warc.read_warc(spark, uri)
    response = F.col("record_type") == "response"
    return back.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op2_html_extract")
def html_extract_query(spark, folder):
    found = html_extract.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


@query("op7_url_filter")
def url_filter_query(spark, folder):
    judged = url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), [url_filter.parse_rule(r) for r in URL_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op4_quality")
def quality_query(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query(
    "op1_jaccard_join",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
      FROM w, LATERAL (SELECT unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM comp LEFT JOIN n USING (doc_id)""",
)
def jaccard_join_query(spark, folder):
    return jaccard_join.similar_groups(table(spark, folder, "documents"), k=3, percent=90)


@query("op11_fill_in_middle")
def fill_in_middle_query(spark, folder):
    return fim.digests(fim.restored(fim.with_digests(fim.assembled(fim.pieces(table(spark, folder, "documents"))))))


@query("op12_align_tokens")
def align_tokens_query(spark, folder):
    found, _ = alignment.align(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path("piece_bpe_32k.model"))
    # the rows are small: few tasks write them, apart from those that hold the blocks' references
    return found.hint("rebalance", "doc_id")




SECRET_KINDS = [r.kind for r in secret_scan.RULES]


def _spans_sql(number: int, rule: secret_scan.Rule) -> str:
    """Matches of a rule with their places: each behind all text before it and all matches before it."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, ends[i] - length(whole[i]) AS a, ends[i] AS b
      FROM (SELECT doc_id, whole, inners, list_transform(range(1, len(whole) + 1), lambda i: list_sum(list_transform(whole[1:i], lambda x: length(x))) + list_sum(list_transform(gaps[1:i], lambda x: length(x)))) AS ends
        FROM (SELECT doc_id, regexp_extract_all(x, '{pattern}') AS whole, regexp_extract_all(x, '{pattern}', {rule.group}) AS inners, regexp_split_to_array(x, '{pattern}') AS gaps FROM d)),
      LATERAL (SELECT unnest(range(1, len(whole) + 1)) AS i) WHERE length(inners[i]) >= {rule.least}"""


@query(
    "op13_secret_scan",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
    s AS ({" UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(secret_scan.RULES))}),
    f AS (SELECT doc_id, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
      string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) AS spans, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) FILTER (k < 3) AS base FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN f USING (doc_id)""",
)
def secret_scan_query(spark, folder):
    docs = table(spark, folder, "documents")
    found = secret_scan.findings(docs, secret_scan.push(docs, scratch_path(spark, "blob-ledger")))
    counts = [secret_scan.count_kind(F.col("found"), k).alias(f"n_{k}") for k in SECRET_KINDS[:3]]
    base = secret_scan.written(F.col("found"), SECRET_KINDS[:3])
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("found")).alias("spans"))
