"""Logical tables of the claim graph, derived from the driver's tables.

Every definition is one SELECT that both Spark and DuckDB accept, so a query and its counterpart SQL start from the same
rows. All of it is synthetic: keys are concatenations, states come from integer remainders, times are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Wall clock of every rule that compares with the present.
NOW = 1706832000

SQL = {
    "sources": """SELECT DISTINCT source AS source_id, source AS identifier, 'domain' AS kind,
        CASE WHEN source IN ('src3', 'src11') THEN 'archived' ELSE 'active' END AS status,
        CAST(length(source) AS INT) + 2 AS recrawl_interval_days,
        CASE WHEN source = 'src5' THEN NULL ELSE 1704067200 + CAST(length(source) AS BIGINT) * 500000 END AS last_full_recrawl_at
        FROM documents WHERE source IS NOT NULL""",
    "runs": """SELECT CAST(event_id AS BIGINT) AS run_id, concat('src', CAST(user_id % 20 AS VARCHAR(9))) AS source_id,
        CASE event_type WHEN 'view' THEN 'parse' WHEN 'click' THEN 'crawl' WHEN 'signup' THEN 'seed' WHEN 'error' THEN 'crawl' ELSE 'enrich' END AS kind,
        CASE WHEN event_id % 11 = 0 THEN 'queued' WHEN event_id % 7 = 0 THEN 'running' WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'stopped' ELSE 'complete' END AS status,
        1704067200 + event_id * 260 AS started_at,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1704067200 + event_id * 260 + event_id % 997 END AS stats_updated_at,
        value AS items, props
        FROM events""",
    "fetches": """SELECT doc_id AS fetch_id, concat('run-', source) AS run_id, source AS source_id,
        concat(source, '/p', CAST(doc_id % 7 AS VARCHAR(9))) AS url, 1704067200 + doc_id * 3600 AS fetched_at,
        CASE WHEN doc_id % 10 = 0 THEN 404 WHEN doc_id % 17 = 0 THEN 503 ELSE 200 END AS http_status,
        CASE WHEN doc_id % 13 <> 0 THEN text END AS body,
        CASE WHEN doc_id % 26 = 0 AND doc_id > 0 THEN doc_id - 26 WHEN doc_id % 39 = 0 AND doc_id > 0 THEN doc_id - 20 END AS body_unchanged_since,
        CASE WHEN doc_id % 23 = 0 THEN 'not_html' END AS parse_skip_reason, text
        FROM documents""",
    "claims": """SELECT l_orderkey * 10 + l_linenumber AS claim_id, concat('s', CAST(l_suppkey AS VARCHAR(20))) AS subject_id,
        CASE WHEN l_returnflag = 'A' THEN 'employed_by' WHEN l_returnflag = 'N' THEN 'founded' ELSE 'has_title' END AS predicate,
        CASE WHEN l_linenumber % 5 <> 0 THEN concat('p', CAST(l_partkey AS VARCHAR(20))) END AS object_id,
        CASE WHEN l_linenumber % 5 = 0 THEN concat('value ', CAST(l_quantity AS INT)) END AS object_value,
        CASE WHEN l_returnflag = 'R' THEN l_orderkey * 1000 END AS valid_to,
        1600000000 + l_orderkey * 100 + l_linenumber AS first_seen_at, l_orderkey AS raw_id
        FROM lineitem""",
    "raws": """SELECT o_orderkey AS raw_id, o_orderkey % 997 AS document_id, concat('src', CAST(o_custkey % 20 AS VARCHAR(9))) AS source_id,
        1600000000 + o_orderkey * 60 AS added_at, o_orderstatus AS subject_type FROM orders""",
    "evidence": """SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS raw_id, concat('src', CAST(o_custkey % 20 AS VARCHAR(9))) AS source_id,
        o_orderkey % 997 AS document_id, 1600000000 + o_orderkey * 60 + l_linenumber AS added_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT l_orderkey * 10 + l_linenumber, o_orderkey, concat('src', CAST(o_custkey % 7 AS VARCHAR(9))), o_orderkey % 499, 1600000000 + o_orderkey * 50
        FROM lineitem JOIN orders ON l_orderkey + 1 = o_orderkey""",
    "entities": """SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS entity_id, 'person' AS kind, s_name AS name, CAST(s_nationkey AS BIGINT) AS group_id, s_acctbal AS weight FROM supplier
        UNION ALL SELECT concat('p', CAST(p_partkey AS VARCHAR(20))), 'project', p_name, CAST(p_size AS BIGINT), p_retailprice FROM part
        UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR(20))), 'organization', c_name, CAST(c_nationkey AS BIGINT), c_acctbal FROM customer""",
    "aliases": """SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS entity_id, concat(s_name, ' Jr') AS alias FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT concat('p', CAST(p_partkey AS VARCHAR(20))), concat('The ', p_name) FROM part WHERE p_partkey % 2 = 0""",
}
#: Names of every shape that the name check tells apart, by supplier; `fine` is what must come out.
SQL["people"] = """SELECT CAST(s_suppkey AS BIGINT) AS person_id, concat('s', CAST(s_suppkey AS VARCHAR(20))) AS entity_id,
        CASE s_suppkey % 12 WHEN 0 THEN 'Ida Lindqvist' WHEN 1 THEN 'Meet Ida Lindqvist' WHEN 2 THEN 'Lindqvist' WHEN 3 THEN 'Ida Lindqvist LLC' WHEN 4 THEN 'ida Lindqvist'
        WHEN 5 THEN 'Market Rally Monday' WHEN 6 THEN 'They Lindqvist' WHEN 7 THEN 'Ida Lindqvist,' WHEN 8 THEN 'Ida 4x9 Lindqvist' WHEN 9 THEN 'Ida Bo Cy Di Ed Lindqvist' WHEN 10 THEN 'Ida. Bo Lindqvist' ELSE 'Anne-Marie d''Arc' END AS name,
        s_suppkey % 12 IN (0, 1) AS fine, s_suppkey % 12 = 1 AS led FROM supplier"""
SQL["fetch_runs"] = "SELECT DISTINCT concat('run-', source) AS run_id, source AS source_id FROM documents WHERE source IS NOT NULL"
SQL["quotes"] = """SELECT o_orderkey AS raw_id, o_orderkey % 997 AS document_id, 1600000000 + o_orderkey * 60 AS added_at, concat('order ', o_orderstatus, ' of customer ', CAST(o_custkey AS VARCHAR(20))) AS quote FROM orders"""
SQL["stored_counters"] = """SELECT source AS source_id, CAST(count(*) % 9 AS BIGINT) AS pages, CAST(7 AS BIGINT) AS urls FROM documents WHERE source IS NOT NULL GROUP BY source"""
SQL["summaries"] = "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS entity_id, 'employed_by' AS predicate, concat('seed ', CAST(s_nationkey AS VARCHAR(9))) AS first_value FROM supplier WHERE s_suppkey % 2 = 0"
SQL["flagged"] = "SELECT entity_id, kind, name, group_id % 3 = 0 AS needs_review FROM entities"
SQL["mentions"] = """SELECT claim_id * 2 AS mention_id, min(raw_id) AS raw_id, 'subject' AS place, min(subject_id) AS entity_id FROM claims GROUP BY claim_id
        UNION ALL SELECT claim_id * 2 + 1, min(raw_id), 'object', min(object_id) FROM claims WHERE object_id IS NOT NULL GROUP BY claim_id"""
SQL["candidates"] = """SELECT claim_id AS candidate_id, CASE WHEN claim_id % 3 <> 0 THEN claim_id * 2 END AS mention_id, min(subject_id) AS candidate_entity_id,
        CASE WHEN claim_id % 4 <> 0 THEN CAST(claim_id % 89 AS DOUBLE) / 100 END AS score, min(first_seen_at) AS created_at,
        CASE WHEN claim_id % 5 = 0 THEN 'merge' WHEN claim_id % 7 = 0 THEN 'split' END AS review_decision FROM claims GROUP BY claim_id"""
SQL["run_events"] = """SELECT run_id % 500 AS run_id, run_id AS seq, status, CASE WHEN status = 'failed' THEN concat('error ', CAST(run_id AS VARCHAR(20))) END AS error, CASE WHEN run_id % 3 = 0 THEN props END AS stats FROM runs"""
SQL["extracted"] = """SELECT person_id AS raw_id, name AS subject_text, CASE WHEN person_id % 13 = 0 THEN 'thing' ELSE 'person' END AS subject_type,
        CASE WHEN person_id % 17 = 0 THEN 'likes' ELSE 'founded' END AS predicate, CASE WHEN person_id % 19 = 0 THEN 'Works,' ELSE 'Harbor Works' END AS object_text, 'org' AS object_type,
        CASE WHEN person_id % 23 = 0 THEN ' ' ELSE 'a quote' END AS raw_quote, fine, led FROM people"""
#: Tables that are built on other logical ones.
SQL["document_rows"] = """SELECT sha256_of AS content_hash, min(fetch_id) AS document_id, min(fetched_at) AS valid_from
        FROM (SELECT fetch_id, fetched_at, {sha256}(text) AS sha256_of FROM fetches WHERE text IS NOT NULL) t GROUP BY sha256_of"""
SQL["links"] = """SELECT d.document_id, f.fetch_id FROM (SELECT fetch_id, {sha256}(text) AS h FROM fetches WHERE fetch_id % 3 <> 0 AND http_status = 200 AND body IS NOT NULL) f
        JOIN document_rows d ON d.content_hash = f.h
        UNION ALL SELECT doc_id + 100000000, doc_id FROM documents WHERE doc_id % 101 = 0"""
SQL["conflicts"] = """SELECT a.claim_id * 100000 + b.claim_id % 100000 AS conflict_id, a.claim_id AS claim_a, b.claim_id AS claim_b, CASE WHEN a.claim_id % 4 = 0 THEN 'a_wins' WHEN a.claim_id % 4 = 1 THEN 'b_wins' WHEN a.claim_id % 4 = 2 THEN 'unresolved' END AS resolution
        FROM claims a JOIN claims b ON a.subject_id = b.subject_id AND a.object_id = b.object_id AND a.predicate <> b.predicate AND a.claim_id < b.claim_id"""
_NEEDS = {"flagged": ("entities",), "mentions": ("claims",), "candidates": ("claims",), "run_events": ("runs",), "extracted": ("people",), "document_rows": ("fetches",), "links": ("fetches", "document_rows"), "conflicts": ("claims",)}


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a logical one as a DataFrame; nothing runs here."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SQL[name].replace("{sha256}", "sha256_")
    needed = {t: logical(spark, sf_dir, t) for t in (*BASE, *_NEEDS.get(name, ())) if _mentions(sql, t)}
    sql = sql.replace("sha256_(text)", "sha2(text, 256)")
    for t in sorted(needed, key=len, reverse=True):
        sql = _substitute(sql, t, f"{{{t}}}")
    return spark.sql(sql, **needed)


def _mentions(sql: str, table: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN) {table}\b", sql) is not None


def _substitute(sql: str, table: str, by: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {by}", sql)


def with_tables(*names: str) -> str:
    """The WITH clause that defines logical tables for DuckDB, in order of need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            need(m)
        if n in SQL and n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n].replace('{sha256}', 'sha256')})" for n in order)
