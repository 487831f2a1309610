"""The registry of claim-graph queries: each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import claims, counters, coverage, crawl, curation, extraction, graph, integrity, retrieval, runs
from ..session import checkpointed, narrow_tasks
from ..streaming import streams
from .bridge import NOW, logical, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(tables: str, sql: str | None = None):
    """Register a builder that is called with its logical tables, and its SQL over the same ones."""
    names = tables.split()

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(*[logical(narrow_tasks(spark), sf_dir, n) for n in names])
        if sql is not None:
            head = with_tables(*names)
            ORACLES[build.__name__] = (head + (", " if " AS (" in head else "") + sql[5:] if sql.startswith("WITH ") else (head if " AS (" in head else "") + " " + sql)
        return build

    return add


OK_2XX = "http_status BETWEEN 200 AND 299"
PENDING = f"SELECT f.* FROM fetches f WHERE {OK_2XX} AND body IS NOT NULL AND body_unchanged_since IS NULL AND parse_skip_reason IS NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.fetch_id = f.fetch_id)"


# Coverage


@query("fetches", f"SELECT source_id, count(DISTINCT url) AS pages_fetched FROM fetches WHERE {OK_2XX} AND (body IS NOT NULL OR body_unchanged_since IS NOT NULL) GROUP BY source_id")
def pages_fetched_by_source(fetches):
    return coverage.pages_fetched(fetches)


@query("fetches", "SELECT source_id, count(DISTINCT url) AS urls_known FROM fetches GROUP BY source_id")
def urls_known_by_source(fetches):
    return coverage.urls_known(fetches)


@query("fetches links", "SELECT source_id, count(DISTINCT document_id) AS documents FROM links JOIN fetches USING (fetch_id) GROUP BY source_id")
def documents_by_source(fetches, links):
    return coverage.documents_per_source(fetches, links)


@query("evidence", "SELECT source_id, count(DISTINCT claim_id) AS claims FROM evidence GROUP BY source_id")
def claims_by_source(evidence):
    return coverage.claims_per_source(evidence)


@query("evidence claims", "SELECT source_id, count(DISTINCT e) AS entities FROM (SELECT source_id, subject_id AS e FROM evidence JOIN claims USING (claim_id) UNION ALL SELECT source_id, object_id FROM evidence JOIN claims USING (claim_id)) x WHERE e IS NOT NULL GROUP BY source_id")
def entities_by_source(evidence, claim_rows):
    return coverage.entities_per_source(evidence, claim_rows)


@query("fetches links", f"SELECT fetch_id, source_id, fetched_at FROM ({PENDING}) p")
def pending_parse_ids(fetches, links):
    return coverage.pending(fetches, links).select("fetch_id", "source_id", "fetched_at")


@query("fetches links", f"SELECT fetch_id, source_id FROM ({PENDING}) p WHERE fetched_at <= 1704967200")
def pending_at_snapshot(fetches, links):
    return coverage.pending(fetches, links, 1704967200).select("fetch_id", "source_id")


@query("fetches links", f"SELECT source_id, least(count(*), 10000) AS pending FROM ({PENDING}) p GROUP BY source_id")
def pending_parse_count(fetches, links):
    return coverage.pending_counts(fetches, links)


@query("fetches", "SELECT fetch_id, fetched_at FROM fetches WHERE source_id = 'src1' AND body IS NOT NULL AND fetched_at <= 1705967200")
def body_fetches_of_source(fetches):
    return coverage.document_fetch_order(fetches, "src1", snapshot=1705967200).select("fetch_id", "fetched_at")


@query("conflicts evidence", "SELECT source_id, count(DISTINCT conflict_id) AS conflicts FROM (SELECT conflict_id, claim_a AS claim_id FROM conflicts UNION ALL SELECT conflict_id, claim_b FROM conflicts) c JOIN evidence USING (claim_id) GROUP BY source_id")
def conflicts_by_source(conflicts, evidence):
    return coverage.conflicts_per_source(conflicts, evidence)


_BEHIND = "behind AS (SELECT DISTINCT l.document_id, r.source_id FROM links l JOIN fetches f ON f.fetch_id = l.fetch_id JOIN fetch_runs r ON r.run_id = f.run_id JOIN document_rows d ON d.document_id = l.document_id)"
_COVER = f"""{_BEHIND}, p AS (SELECT source_id, count(DISTINCT url) AS n FROM fetches WHERE {OK_2XX} AND (body IS NOT NULL OR body_unchanged_since IS NOT NULL) GROUP BY source_id),
u AS (SELECT source_id, count(DISTINCT url) AS n FROM fetches GROUP BY source_id),
d AS (SELECT source_id, count(DISTINCT document_id) AS n FROM links JOIN fetches USING (fetch_id) GROUP BY source_id),
sc AS (SELECT DISTINCT b.source_id, e.claim_id FROM evidence e JOIN quotes q ON q.raw_id = e.raw_id JOIN behind b ON b.document_id = q.document_id),
c AS (SELECT source_id, count(*) AS n FROM sc GROUP BY source_id),
en AS (SELECT b.source_id, count(DISTINCT m.entity_id) AS n FROM mentions m JOIN quotes q ON q.raw_id = m.raw_id JOIN behind b ON b.document_id = q.document_id GROUP BY b.source_id),
w AS (SELECT source_id, least(count(*), 10000) AS n FROM ({PENDING}) x GROUP BY source_id),
k AS (SELECT source_id, count(DISTINCT conflict_id) AS n FROM (SELECT conflict_id, claim_a AS claim_id FROM conflicts UNION ALL SELECT conflict_id, claim_b FROM conflicts) z JOIN sc USING (claim_id) GROUP BY source_id),
cover AS (SELECT s.source_id, coalesce(p.n, 0) AS pages_fetched, greatest(coalesce(u.n, 0), coalesce(p.n, 0)) AS urls_known, coalesce(d.n, 0) AS documents, coalesce(c.n, 0) AS claims, coalesce(en.n, 0) AS entities, coalesce(w.n, 0) AS pending, coalesce(k.n, 0) AS conflicts
FROM sources s LEFT JOIN p ON s.source_id = p.source_id LEFT JOIN u ON s.source_id = u.source_id LEFT JOIN d ON s.source_id = d.source_id LEFT JOIN c ON s.source_id = c.source_id LEFT JOIN en ON s.source_id = en.source_id LEFT JOIN w ON s.source_id = w.source_id LEFT JOIN k ON s.source_id = k.source_id)"""
_COVER_TABLES = "sources fetches links document_rows fetch_runs evidence quotes mentions conflicts"
_MEASURES = ("pages_fetched", "urls_known", "documents", "claims", "entities", "pending", "conflicts")


@query(_COVER_TABLES, f"WITH {_COVER} SELECT * FROM cover")
def source_coverage(*tables):
    return coverage.full_coverage(*tables)


@query(_COVER_TABLES, f"WITH {_COVER} SELECT count(*) AS sources, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}_sum' for m in _MEASURES)} FROM cover WHERE source_id NOT IN ('src3', 'src11')")
def global_stats(sources, *tables):
    return coverage.totals(coverage.full_coverage(sources, *tables), sources)


@query("fetches", f"WITH u AS (SELECT source_id, count(DISTINCT url) AS urls_known, count(DISTINCT CASE WHEN {OK_2XX} AND (body IS NOT NULL OR body_unchanged_since IS NOT NULL) THEN url END) AS pages_fetched FROM fetches WHERE source_id IS NOT NULL GROUP BY source_id) SELECT source_id, pages_fetched, urls_known FROM u WHERE urls_known > 0")
def incremental_counters(fetches):
    """Counters after three days' fetches, each of which updates what the days before have stored; the second comes twice."""
    spark = fetches.sparkSession
    day = F.col("fetched_at")
    days = [fetches.filter(day < 1704800000), fetches.filter(day.between(1704800000, 1705900000)), fetches.filter(day > 1705900000)]
    numbers, sets = spark.createDataFrame([], counters.NUMBERS), spark.createDataFrame([], counters.COUNTERS)
    for k in (0, 1, 1, 2):
        numbers, sets = (checkpointed(t) for t in counters.updated(days[k], numbers, sets))
    return counters.counted(sets)


@query("sources stored_counters fetches", f"WITH u AS (SELECT source_id, count(DISTINCT url) AS n FROM fetches GROUP BY source_id), p AS (SELECT source_id, count(DISTINCT url) AS n FROM fetches WHERE {OK_2XX} AND (body IS NOT NULL OR body_unchanged_since IS NOT NULL) GROUP BY source_id) SELECT s.source_id, k.pages - coalesce(p.n, 0) AS pages_drift, k.urls - greatest(coalesce(u.n, 0), coalesce(p.n, 0)) AS urls_drift FROM sources s JOIN stored_counters k ON k.source_id = s.source_id LEFT JOIN u ON s.source_id = u.source_id LEFT JOIN p ON s.source_id = p.source_id")
def counter_drift(sources, stored, fetches):
    return coverage.counter_drift(stored, coverage.coverage(sources, coverage.pages_fetched(fetches), coverage.urls_known(fetches)))


# Claims


@query("claims entities", "SELECT claim_id, subject_id, predicate, s.name AS subject_name, s.kind AS subject_kind, o.name AS object_name FROM claims JOIN entities s ON s.entity_id = subject_id LEFT JOIN entities o ON o.entity_id = object_id WHERE valid_to IS NULL AND predicate = 'founded' AND (o.name ILIKE '%ring%' OR object_value ILIKE '%1%' OR s.name ILIKE '%00007%') ORDER BY first_seen_at DESC, claim_id LIMIT 50 OFFSET 50")
def claim_browse(rows, entities):
    named = claims.with_endpoints(claims.by_status(rows.filter("predicate = 'founded'"), "current"), entities)
    hit = named.filter(claims.contains_any("ring", "object_name") | claims.contains_any("1", "object_value") | claims.contains_any("00007", "subject_name"))
    return claims.page(hit, 2, 50, 200, F.desc("first_seen_at"), F.col("claim_id")).select("claim_id", "subject_id", "predicate", "subject_name", "subject_kind", "object_name")


@query("claims", "SELECT CASE WHEN valid_to IS NULL THEN 'current' ELSE 'superseded' END AS status, count(*) AS claims FROM claims GROUP BY 1")
def claims_by_status(rows):
    parts = [claims.by_status(rows, s).agg(F.lit(s).alias("status"), F.count("*").alias("claims")) for s in ("current", "superseded")]
    return parts[0].union(parts[1]).filter("claims > 0")


@query("claims evidence", "SELECT claim_id, subject_id FROM claims c WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND e.source_id = 'src2')")
def claims_by_source_semi(rows, evidence):
    return claims.of_source(rows, evidence, "src2").select("claim_id", "subject_id")


@query("claims evidence", "SELECT claim_id FROM claims c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND e.source_id <> 'src2' AND e.source_id <> 'src4')")
def claims_without_evidence(rows, evidence):
    return claims.without_evidence(rows, evidence.filter("source_id not in ('src2', 'src4')")).select("claim_id")


@query("claims", "SELECT claim_id, predicate FROM claims WHERE subject_id = 's7' OR object_id = 's7'")
def claims_of_entity(rows):
    return claims.touching(rows, "s7").select("claim_id", "predicate")


@query("evidence", "SELECT claim_id, count(DISTINCT raw_id) AS evidence_count FROM evidence GROUP BY claim_id")
def claim_evidence_counts(evidence):
    return claims.evidence_counts(evidence)


@query("evidence", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY claim_id, document_id ORDER BY added_at DESC, source_id, raw_id) AS n FROM evidence), k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY added_at DESC, document_id) AS rank FROM o WHERE n = 1) SELECT claim_id, document_id, source_id, rank FROM k WHERE rank <= 3")
def claim_sources_top3(evidence):
    return claims.newest_documents(evidence).select("claim_id", "document_id", "source_id", "rank")


@query("evidence", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY source_id, raw_id, document_id ORDER BY added_at DESC, claim_id) AS n FROM evidence) SELECT source_id, raw_id, document_id, claim_id FROM o WHERE n = 1")
def evidence_deduped(evidence):
    return claims.first_per_key(evidence, ["source_id", "raw_id", "document_id"], F.desc("added_at"), F.col("claim_id")).select("source_id", "raw_id", "document_id", "claim_id")


@query("claims", "SELECT DISTINCT predicate FROM claims")
def claim_predicates(rows):
    return rows.select("predicate").distinct()


@query("claims entities evidence", """WITH e AS (SELECT claim_id, count(*) AS evidence_rows FROM (SELECT DISTINCT claim_id, source_id, raw_id, document_id FROM evidence) x GROUP BY claim_id)
SELECT c.claim_id, concat_ws(' ', nullif(trim(replace(s.name, '_', ' ')), ''), nullif(trim(replace(predicate, '_', ' ')), ''), nullif(trim(replace(coalesce(o.name, object_value), '_', ' ')), '')) AS statement, coalesce(evidence_rows, 0) AS evidence_rows
FROM claims c JOIN entities s ON s.entity_id = subject_id LEFT JOIN entities o ON o.entity_id = object_id LEFT JOIN e ON e.claim_id = c.claim_id""")
def claim_detail(rows, entities, evidence):
    named = claims.with_endpoints(rows, entities).withColumn("target", F.coalesce("object_name", "object_value"))
    backing = evidence.select("claim_id", "source_id", "raw_id", "document_id").distinct().groupBy("claim_id").agg(F.count("*").alias("evidence_rows"))
    return named.join(backing, "claim_id", "left").select("claim_id", claims.statement("subject_name", "predicate", "target").alias("statement"), F.coalesce("evidence_rows", F.lit(0)).alias("evidence_rows"))


@query("claims", "SELECT CASE WHEN subject_id IS NULL THEN 'missing_subject' WHEN predicate NOT IN ('employed_by', 'founded', 'has_title') THEN 'unknown_predicate' WHEN object_id IS NULL AND object_value IS NULL THEN 'missing_object' WHEN length(object_value) > 7 THEN 'value_too_long' END AS reason, count(*) AS claims FROM (SELECT *, NULL AS x FROM claims) c GROUP BY 1")
def claim_validation(rows):
    shorter = rows.withColumn("object_value", F.concat("object_value", F.lit("x")))
    return claims.validated(shorter).groupBy("reason").agg(F.count("*").alias("claims"))


@query("claims", "SELECT a.claim_id AS claim_a, b.claim_id AS claim_b FROM claims a JOIN claims b ON a.subject_id = b.subject_id AND a.object_id = b.object_id AND a.predicate <> b.predicate AND a.claim_id < b.claim_id")
def conflict_detection(rows):
    return claims.detect_conflicts(rows)


@query("conflicts", "SELECT conflict_id, claim_a, claim_b FROM conflicts WHERE resolution = 'unresolved' OR resolution IS NULL ORDER BY conflict_id LIMIT 200 OFFSET 200")
def unresolved_conflicts(conflicts):
    return claims.page(claims.unresolved(conflicts), 2, 200, 200, F.col("conflict_id")).select("conflict_id", "claim_a", "claim_b")


@query("conflicts", "SELECT conflict_id, CASE resolution WHEN 'a_wins' THEN claim_b ELSE claim_a END AS claim_id, 'retract' AS signal FROM conflicts WHERE resolution IN ('a_wins', 'b_wins')")
def resolve_conflicts(conflicts):
    return claims.resolve(conflicts)


# Integrity


@query("fetches", "SELECT h AS content_hash, count(*) AS fetches, min(fetched_at) AS valid_from, min(fetch_id) AS first_fetch_id FROM (SELECT sha256(body) AS h, * FROM fetches WHERE body IS NOT NULL) x GROUP BY h")
def content_hash_dedup(fetches):
    return integrity.content_documents(fetches)


@query("fetches document_rows", "SELECT sha256(body) AS content_hash, count(*) AS fetches FROM fetches WHERE body IS NOT NULL AND sha256(body) NOT IN (SELECT content_hash FROM document_rows WHERE document_id % 2 = 0) GROUP BY 1")
def new_content(fetches, known):
    return integrity.new_hashes(fetches, known.filter("document_id % 2 = 0")).select("content_hash", "fetches")


@query("links", "SELECT document_id, count(DISTINCT fetch_id) AS fetches FROM links GROUP BY document_id")
def document_links(links):
    return links.dropDuplicates(["document_id", "fetch_id"]).groupBy("document_id").agg(F.count("*").alias("fetches"))


@query("fetches", f"WITH r AS (SELECT fetch_id, sha256(body) AS h, lag(fetch_id) OVER w AS previous_id, lag(sha256(body)) OVER w AS ph FROM fetches WHERE {OK_2XX} AND body IS NOT NULL WINDOW w AS (PARTITION BY source_id, url ORDER BY fetched_at, fetch_id)) SELECT fetch_id, previous_id, h = ph AS unchanged FROM r WHERE previous_id IS NOT NULL")
def unchanged_refetches(fetches):
    return integrity.unchanged_refetches(fetches)


_CHAIN = """walk AS (SELECT fetch_id, body_unchanged_since AS next, 0 AS n FROM fetches WHERE body IS NULL AND body_unchanged_since IS NOT NULL
UNION ALL SELECT w.fetch_id, f.body_unchanged_since, w.n + 1 FROM walk w JOIN fetches f ON f.fetch_id = w.next AND f.body IS NULL AND w.n < 500 WHERE w.next IS NOT NULL),
chains AS (SELECT w.fetch_id, CASE WHEN max(CASE WHEN f.body IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'resolved' ELSE 'broken' END AS state FROM walk w LEFT JOIN fetches f ON f.fetch_id = w.next GROUP BY w.fetch_id)"""


@query("fetches", f"WITH {_CHAIN} SELECT fetch_id, state FROM chains")
def body_chain_status(fetches):
    return integrity.chain_status(fetches)


@query("links document_rows fetches", "SELECT document_id, fetch_id, 'document' AS missing FROM links WHERE document_id NOT IN (SELECT document_id FROM document_rows) UNION ALL SELECT document_id, fetch_id, 'fetch' FROM links WHERE fetch_id NOT IN (SELECT fetch_id FROM fetches)")
def dangling_links(links, documents, fetches):
    return integrity.dangling_links(links, documents, fetches)


@query("document_rows links", f"SELECT document_id, content_hash FROM document_rows d WHERE valid_from < {NOW} - 604800 AND NOT EXISTS (SELECT 1 FROM links l WHERE l.document_id = d.document_id)")
def orphan_documents(documents, links):
    return integrity.orphan_documents(documents, links, NOW).select("document_id", "content_hash")


@query("fetches links document_rows", f"WITH {_CHAIN} SELECT (SELECT count(*) FROM ({PENDING}) p) AS missing_documents, (SELECT count(*) FROM links WHERE document_id NOT IN (SELECT document_id FROM document_rows)) + (SELECT count(*) FROM links WHERE fetch_id NOT IN (SELECT fetch_id FROM fetches)) AS dangling_links, (SELECT count(*) FROM chains WHERE state = 'broken') AS broken_chains, false AS ok")
def integrity_report(fetches, links, documents):
    return integrity.report(fetches, links, documents, integrity.chain_status(fetches))


# Graph

_EDGES = "edges AS (SELECT claim_id, predicate, subject_id AS entity_id, object_id AS neighbor_id FROM claims WHERE object_id IS NOT NULL UNION ALL SELECT claim_id, predicate, object_id, subject_id FROM claims WHERE object_id IS NOT NULL)"


@query("claims evidence", f"WITH {_EDGES} SELECT entity_id, neighbor_id, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates, count(DISTINCT raw_id) AS evidence_count FROM edges LEFT JOIN evidence USING (claim_id) GROUP BY entity_id, neighbor_id")
def entity_neighborhood(rows, evidence):
    return graph.neighborhood(rows, evidence)


@query("claims evidence entities", f"WITH {_EDGES}, ends AS (SELECT claim_id, subject_id AS entity_id FROM claims UNION ALL SELECT claim_id, object_id FROM claims WHERE object_id IS NOT NULL), dg AS (SELECT entity_id, count(DISTINCT neighbor_id) AS n FROM edges GROUP BY entity_id), sc AS (SELECT entity_id, count(DISTINCT source_id) AS n FROM ends JOIN evidence USING (claim_id) GROUP BY entity_id) SELECT x.entity_id, coalesce(name, concat('Unknown entity ', left(x.entity_id, 8))) AS display_name, coalesce(dg.n, 0) AS connection_count, coalesce(sc.n, 0) AS source_count FROM (SELECT DISTINCT entity_id FROM ends) x LEFT JOIN entities e ON e.entity_id = x.entity_id LEFT JOIN dg ON dg.entity_id = x.entity_id LEFT JOIN sc ON sc.entity_id = x.entity_id")
def entity_summary(rows, evidence, entities):
    return graph.summary(rows, evidence, entities)


@query("claims", "SELECT subject_id, predicate, string_agg(DISTINCT object_value, '|' ORDER BY object_value) AS values, count(*) AS claims FROM claims WHERE object_id IS NULL GROUP BY subject_id, predicate")
def attribute_groups(rows):
    return graph.attributes(rows)


@query("claims", "SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, count(*) AS claims, count(DISTINCT predicate) AS predicates, bool_and(valid_to IS NOT NULL) AS all_ended FROM claims WHERE object_id IS NOT NULL GROUP BY 1, 2")
def undirected_edges(rows):
    return graph.undirected(rows)


@query("claims", f"WITH {_EDGES} SELECT 's3' AS node, 0 AS ring UNION ALL SELECT DISTINCT neighbor_id, 1 FROM edges WHERE entity_id = 's3'")
def star_graph(rows):
    return graph.star(rows, "s3")


@query("entities", "SELECT entity_id, name FROM entities WHERE name ILIKE '%widget%' ORDER BY name, entity_id LIMIT 25")
def entity_search(entities):
    return graph.search(entities, "widget").select("entity_id", "name")


def trigrams_sql(name: str) -> str:
    """The distinct trigrams of a name, as graph.trigrams has them."""
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({name}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


#: Resembling labels of entities by any-shared-trigram counts over all pairs; {names} is a subquery with a column name.
RESEMBLING = f"""labels AS (SELECT entity_id, name AS label, 0 AS rank FROM entities UNION ALL SELECT entity_id, alias, 1 FROM aliases),
lg AS (SELECT label, len(g) AS n, unnest(g) AS t FROM (SELECT label, {trigrams_sql('label')} AS g FROM (SELECT DISTINCT label FROM labels) x) y),
qg AS (SELECT name, len(g) AS n, unnest(g) AS t FROM (SELECT name, {trigrams_sql('name')} AS g FROM (SELECT DISTINCT name FROM {{names}}) x) y),
pairs AS (SELECT q.name, l.label, CAST(count(*) AS DOUBLE) / (any_value(q.n) + any_value(l.n) - count(*)) AS score FROM qg q JOIN lg l ON q.t = l.t GROUP BY q.name, l.label),
owned AS (SELECT p.name, l.entity_id, p.label, p.score, row_number() OVER (PARTITION BY p.name, l.entity_id ORDER BY p.score DESC, l.rank, p.label DESC) AS r FROM pairs p JOIN labels l USING (label) WHERE p.score > {{threshold}}),
best AS (SELECT name, entity_id, label, round(score, 6) AS score FROM owned WHERE r = 1)"""
_ONE = RESEMBLING.format(names="(SELECT 'the red widgets' AS name)", threshold=0.3)


@query("entities aliases", f"WITH {_ONE} SELECT entity_id, label, score FROM best")
def trigram_match(entities, aliases):
    return graph.trigram_matches(entities, aliases, "the red widgets")


@query("part entities aliases", f"WITH {RESEMBLING.format(names='(SELECT p_name AS name FROM part)', threshold=0.5)} SELECT name, entity_id, label, score FROM best")
def trigram_join(part, entities, aliases):
    """Every part's name against the names and aliases of all entities."""
    return graph.resembling_entities(part.select(F.col("p_name").alias("name")), entities, aliases, 0.5)


# Runs


@query("runs", "SELECT run_id, source_id, n FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs) x WHERE n <= 5")
def recent_runs_top5(rows):
    return runs.recent(rows).select("run_id", "source_id", "n")


@query("runs", "SELECT source_id, action, run_id FROM (SELECT *, CASE WHEN kind = 'parse' THEN 'parse' ELSE 'crawl' END AS action, row_number() OVER (PARTITION BY source_id, CASE WHEN kind = 'parse' THEN 'parse' ELSE 'crawl' END ORDER BY started_at, run_id) AS n FROM runs WHERE status IN ('queued', 'running')) x WHERE n = 1")
def active_runs(rows):
    return runs.active(rows).select("source_id", "action", "run_id")


@query("runs", "SELECT source_id, action, run_id FROM (SELECT *, CASE WHEN kind = 'parse' THEN 'parse' ELSE 'crawl' END AS action, row_number() OVER (PARTITION BY source_id, CASE WHEN kind = 'parse' THEN 'parse' ELSE 'crawl' END ORDER BY started_at DESC, run_id DESC) AS n FROM runs WHERE status = 'stopped') x WHERE n = 1")
def stopped_runs(rows):
    return runs.stopped(rows).select("source_id", "action", "run_id")


@query("runs", "SELECT source_id, run_id, status, started_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs WHERE kind <> 'parse') x WHERE n = 1")
def latest_crawl_runs(rows):
    return runs.latest_crawl(rows)


@query("runs", f"SELECT run_id, source_id FROM runs WHERE status = 'running' AND coalesce(stats_updated_at, started_at) < {NOW} - 1800")
def stale_runs(rows):
    return runs.stale(rows, NOW).select("run_id", "source_id")


@query("runs", "SELECT source_id, kind, count(*) AS active FROM runs WHERE status IN ('queued', 'running') GROUP BY source_id, kind HAVING count(*) > 1")
def duplicate_active_runs(rows):
    return runs.duplicate_active(rows)


_DUE = f"(last_full_recrawl_at IS NULL OR {NOW} - last_full_recrawl_at >= greatest(1, coalesce(nullif(recrawl_interval_days, 0), 7)) * 86400)"


@query("sources", f"SELECT source_id, {_DUE} AS due FROM sources")
def due_recrawl(sources):
    return sources.select("source_id", runs.due(NOW).alias("due"))


@query("sources runs fetches links", f"WITH w AS (SELECT source_id, count(*) AS n FROM ({PENDING}) x GROUP BY source_id) SELECT s.source_id, CASE WHEN s.source_id IN (SELECT source_id FROM runs WHERE status IN ('queued', 'running')) THEN 'active' WHEN w.n > 0 THEN 'pending' WHEN {_DUE} THEN 'due' WHEN last_full_recrawl_at IS NOT NULL THEN 'up-to-date' ELSE 'idle' END AS state FROM sources s LEFT JOIN w ON w.source_id = s.source_id")
def source_state(sources, rows, fetches, links):
    return runs.source_state(sources, runs.active(rows), coverage.pending_counts(fetches, links), NOW)


@query("runs", "SELECT before, after, count(*) AS steps, concat(before, '>', after) IN ('queued>running', 'running>complete', 'running>failed', 'running>stopped', 'stopped>queued') AS allowed FROM (SELECT status AS after, lag(status) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS before FROM runs) x WHERE before IS NOT NULL GROUP BY before, after")
def run_transitions(rows):
    return runs.transitions(rows)


_STEPS = ", ".join(f"'{s}'" for s in (*runs.ALLOWED, *runs.STARTS))


@query("runs", f"WITH o AS (SELECT run_id, source_id, status, row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS n FROM runs), s AS (SELECT run_id, source_id, status, n, status AS state FROM o WHERE n = 1 UNION ALL SELECT o.run_id, o.source_id, o.status, o.n, CASE WHEN concat(s.state, '>', o.status) IN ({_STEPS}) THEN o.status ELSE s.state END FROM s JOIN o ON o.source_id = s.source_id AND o.n = s.n + 1) SELECT run_id, source_id, status, state FROM s")
def run_states(rows):
    return runs.states(rows).select("run_id", "source_id", "status", "state")


@query("runs", "SELECT source_id, round(sum(items), 2) AS cost, count(*) AS runs, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM runs GROUP BY source_id")
def run_accounting(rows):
    return runs.accounting(rows)


@query("runs", "SELECT source_id, count(*) FILTER (WHERE status = 'complete') AS good, count(*) FILTER (WHERE status = 'failed') AS bad, CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'complete' WHEN count(*) FILTER (WHERE status = 'complete') > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM runs GROUP BY source_id")
def run_outcome(rows):
    return runs.outcome(rows)


@query("runs", "SELECT run_id, CASE WHEN run_id % 4 = 0 THEN 60.0 ELSE 20.0 + 40.0 * (run_id % 3) / (run_id % 4) END AS percent FROM runs")
def progress_rescale(rows):
    return rows.select("run_id", runs.rescaled(F.col("run_id") % 3, F.col("run_id") % 4, 20.0, 60.0).alias("percent"))


@query("runs", "SELECT run_id, max(least(99.9, round(items, 1))) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS percent FROM runs")
def crawl_percent(rows):
    return runs.monotone(rows).select("run_id", "percent")


@query("runs", "SELECT source_id, run_id, status FROM (SELECT *, lag(status) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS before FROM runs) x WHERE status IS DISTINCT FROM before")
def progress_changes(rows):
    return runs.progress_changes(rows)


@query("runs", "SELECT run_id, source_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 2000")
def log_tail_2000(rows):
    return curation.capped_log(rows, 2000).select("run_id", "source_id")


@query("runs", "WITH o AS (SELECT source_id AS host, row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS n, status = 'failed' AS slow FROM runs), fold AS (SELECT host, CAST(0 AS BIGINT) AS n, CAST(0.25 AS DOUBLE) AS delay FROM (SELECT DISTINCT host FROM o) h UNION ALL SELECT f.host, f.n + 1, CASE WHEN o.slow THEN least(300.0, greatest(f.delay * 2, 5.0)) ELSE greatest(0.1, f.delay * 0.9) END FROM fold f JOIN o ON o.host = f.host AND o.n = f.n + 1) SELECT host, round(delay, 6) AS delay FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC) AS r FROM fold) x WHERE r = 1")
def host_pacing(rows):
    return runs.pacing(rows)


def limited_sql(rows: str, allowed: int, seconds: int) -> str:
    """Recursive steps over rows (id, client, tick): s has each with whether it is accepted."""
    near = f"list_filter(s.recent, lambda t: t > o.tick - {seconds})"
    return f"o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY tick, id) AS n FROM ({rows}) r), s AS (SELECT id, client, n, true AS accepted, [tick] AS recent FROM o WHERE n = 1 UNION ALL SELECT o.id, o.client, o.n, len({near}) < {allowed}, CASE WHEN len({near}) < {allowed} THEN list_append({near}, o.tick) ELSE {near} END FROM s JOIN o ON o.client = s.client AND o.n = s.n + 1)"


@query("runs", f"WITH {limited_sql('SELECT run_id AS id, source_id AS client, started_at AS tick FROM runs', 3, 86400)} SELECT client, CAST(count(*) FILTER (WHERE accepted) AS INT) AS accepted, CAST(count(*) FILTER (WHERE NOT accepted) AS INT) AS refused FROM s GROUP BY client")
def rate_limit(rows):
    return runs.rate_limit(rows)


@query("runs", "SELECT source_id, kind, count(*) AS events, CAST(sum(CAST(regexp_extract(props, ': *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total FROM runs GROUP BY source_id, kind")
def run_stats_json(rows):
    return rows.groupBy("source_id", "kind").agg(F.count("*").alias("events"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


# Curation


@query("pages runs", r"WITH n AS (SELECT page_id, CASE WHEN contains(lower(url), 'sitemap') THEN url ELSE regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':.*$', ''), '^www\.', '') END AS identifier FROM pages), r AS (SELECT CAST(substr(source_id, 4) AS BIGINT) AS page_id, count(*) AS runs FROM runs GROUP BY 1), c AS (SELECT n.page_id, n.identifier, coalesce(r.runs, 0) AS runs FROM n LEFT JOIN r ON r.page_id = n.page_id) SELECT page_id AS source_id, first_value(page_id) OVER (PARTITION BY identifier ORDER BY runs DESC, page_id) AS survivor_id, identifier, runs FROM c")
def merged_page_sources(pages, rows):
    """Each page's URL as a source of its own, merged by host."""
    sources = pages.select(F.col("page_id").alias("source_id"), F.lit("domain").alias("kind"), F.col("url").alias("identifier"), F.col("page_id").alias("created_at"))
    return curation.sources_merged(sources, rows.select(F.substring("source_id", 4, 9).cast("long").alias("source_id")))


_CHAINED = "m AS (SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS entity_id, concat('s', CAST(s_suppkey - s_suppkey % 4 AS VARCHAR(20))) AS target_id FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey - s_suppkey % 4 > 0)"


@query("supplier entities aliases claims mentions evidence", f"WITH {_CHAINED}, a AS (SELECT coalesce(m.target_id, subject_id) AS s, coalesce(o.target_id, object_id) AS o, predicate FROM claims LEFT JOIN m ON m.entity_id = subject_id LEFT JOIN m o ON o.entity_id = object_id) SELECT 'entity' AS part, e.entity_id AS id, CASE WHEN m.target_id IS NOT NULL THEN concat('merged into ', m.target_id) WHEN e.entity_id IN (SELECT target_id FROM m) THEN 'verified' ELSE 'active' END AS state, CAST(1 AS BIGINT) AS rows FROM entities e LEFT JOIN m ON m.entity_id = e.entity_id UNION ALL SELECT 'claims of', s, predicate, count(*) FROM a GROUP BY s, predicate UNION ALL SELECT 'mentions of', coalesce(m.target_id, x.entity_id), place, count(*) FROM mentions x LEFT JOIN m ON m.entity_id = x.entity_id GROUP BY 2, 3")
def merged_identities(supplier, entities, aliases, rows, mentions, evidence):
    """Suppliers merged in chains of up to three, each into the one before: entities, claims and mentions afterwards."""
    k = F.col("s_suppkey")
    step = supplier.filter((k % 4 > 0) & (k - k % 4 > 0)).select(F.concat(F.lit("s"), k.cast("string")).alias("entity_id"), F.concat(F.lit("s"), (k - 1).cast("string")).alias("target_id"))
    after = curation.entities_merged(entities, aliases, rows, mentions, graph.neighborhood(rows, evidence), step)
    state = F.when(F.col("merged_into").isNotNull(), F.concat(F.lit("merged into "), "merged_into")).when(F.col("verified"), "verified").otherwise("active")
    listed = after["entities"].select(F.lit("entity").alias("part"), F.col("entity_id").alias("id"), state.alias("state"), F.lit(1).cast("long").alias("rows"))
    held = after["claims"].groupBy(F.col("subject_id").alias("id"), F.col("predicate").alias("state")).agg(F.count("*").alias("rows")).select(F.lit("claims of").alias("part"), "id", "state", "rows")
    said = after["mentions"].groupBy(F.col("entity_id").alias("id"), F.col("place").alias("state")).agg(F.count("*").alias("rows")).select(F.lit("mentions of").alias("part"), "id", "state", "rows")
    return listed.unionByName(held).unionByName(said)


_GONE = "own AS (SELECT fetch_id FROM fetches WHERE source_id = 'src4'), lft AS (SELECT * FROM links WHERE fetch_id NOT IN (SELECT fetch_id FROM own)), cutl AS (SELECT DISTINCT document_id FROM links WHERE fetch_id IN (SELECT fetch_id FROM own)), gone AS (SELECT document_id FROM cutl WHERE document_id NOT IN (SELECT document_id FROM lft)), ev AS (SELECT * FROM evidence WHERE source_id IS DISTINCT FROM 'src4' AND raw_id NOT IN (SELECT raw_id FROM quotes WHERE document_id IN (SELECT document_id FROM gone))), cl AS (SELECT * FROM claims WHERE claim_id IN (SELECT claim_id FROM ev))"


@query("fetches links document_rows quotes claims evidence conflicts entities aliases", f"WITH {_GONE} SELECT 'document' AS part, CAST(d.document_id AS VARCHAR) AS id, CASE WHEN c.document_id IS NOT NULL THEN (SELECT min(fetch_id) FROM lft WHERE lft.document_id = d.document_id) ELSE d.document_id END AS first_fetch_id FROM document_rows d LEFT JOIN cutl c ON c.document_id = d.document_id WHERE d.document_id NOT IN (SELECT document_id FROM gone) UNION ALL SELECT 'claim', CAST(claim_id AS VARCHAR), NULL FROM cl UNION ALL SELECT 'conflict', CAST(conflict_id AS VARCHAR), NULL FROM conflicts WHERE claim_a IN (SELECT claim_id FROM cl) AND claim_b IN (SELECT claim_id FROM cl) UNION ALL SELECT 'entity', entity_id, NULL FROM entities WHERE entity_id IN (SELECT subject_id FROM cl UNION SELECT object_id FROM cl WHERE object_id IS NOT NULL UNION SELECT entity_id FROM aliases)")
def tables_without_source(fetches, links, documents, raws, rows, evidence, conflicts, entities, aliases):
    """What is left of documents, claims, conflicts and entities once a source has been deleted."""
    after = curation.source_deleted("src4", fetches, links, documents.select("document_id", F.col("document_id").alias("first_fetch_id")), raws, rows, evidence, conflicts, entities, aliases)
    part = lambda name, table, key, extra=None: after[table].select(F.lit(name).alias("part"), F.col(key).cast("string").alias("id"), (F.col(extra) if extra else F.lit(None)).cast("long").alias("first_fetch_id"))
    return part("document", "documents", "document_id", "first_fetch_id").unionByName(part("claim", "claims", "claim_id")).unionByName(part("conflict", "conflicts", "conflict_id")).unionByName(part("entity", "entities", "entity_id"))


@query("evidence claims conflicts", "WITH lost AS (SELECT claim_id FROM evidence GROUP BY claim_id HAVING bool_and(document_id % 10 = 0)) SELECT 'claims' AS part, count(*) AS rows FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM lost) UNION ALL SELECT 'conflicts', count(*) FROM conflicts WHERE claim_a NOT IN (SELECT claim_id FROM lost) AND claim_b NOT IN (SELECT claim_id FROM lost) UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE document_id % 10 <> 0 UNION ALL SELECT 'lost_claims', count(*) FROM lost")
def delete_document_effect(evidence, rows, conflicts):
    after = curation.delete_document(evidence.filter("document_id % 10 = 0").select("document_id").distinct(), rows, evidence, conflicts)
    parts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("rows")) for name, df in sorted(after.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("fetches links claims evidence", "WITH own AS (SELECT fetch_id FROM fetches WHERE source_id = 'src4'), cutl AS (SELECT * FROM links WHERE fetch_id IN (SELECT fetch_id FROM own)), lft AS (SELECT * FROM links WHERE fetch_id NOT IN (SELECT fetch_id FROM own)) SELECT 'fetches' AS part, count(*) AS rows FROM own UNION ALL SELECT 'links', count(*) FROM cutl UNION ALL SELECT 'orphan_documents', count(*) FROM (SELECT DISTINCT document_id FROM cutl) c WHERE document_id NOT IN (SELECT document_id FROM lft) UNION ALL SELECT 'kept_documents', count(*) FROM (SELECT DISTINCT document_id FROM cutl) c WHERE document_id IN (SELECT document_id FROM lft) UNION ALL SELECT 'swept_claims', count(*) FROM claims c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND e.source_id <> 'src4')")
def delete_source_effect(fetches, links, rows, evidence):
    return curation.delete_source("src4", fetches, links, rows, evidence)


@query("document_rows links fetches", "WITH own AS (SELECT fetch_id FROM fetches WHERE source_id = 'src4') SELECT d.document_id, min(l.fetch_id) AS first_fetch_id FROM document_rows d JOIN links l ON l.document_id = d.document_id AND l.fetch_id NOT IN (SELECT fetch_id FROM own) WHERE d.document_id IN (SELECT document_id FROM links WHERE fetch_id IN (SELECT fetch_id FROM own)) GROUP BY d.document_id")
def repoint_first_seen(documents, links, fetches):
    return curation.repoint_first_seen(documents, links, fetches.filter("source_id = 'src4'").select("fetch_id"))


def _merges(entities):
    return entities.filter("kind = 'person' and group_id % 5 = 1").select("entity_id", F.lit("s1").alias("target_id")).filter("entity_id <> 's1'")


_MERGES = "m AS (SELECT entity_id, 's1' AS target_id FROM entities WHERE kind = 'person' AND group_id % 5 = 1 AND entity_id <> 's1')"


@query("claims entities", f"WITH {_MERGES} SELECT claim_id, coalesce(a.target_id, subject_id) AS subject_id, predicate, coalesce(b.target_id, object_id) AS object_id FROM claims LEFT JOIN m a ON a.entity_id = subject_id LEFT JOIN m b ON b.entity_id = object_id")
def merge_entities(rows, entities):
    return curation.merge_entities(rows, _merges(entities))


@query("aliases entities", f"WITH {_MERGES}, al AS (SELECT coalesce(target_id, a.entity_id) AS entity_id, alias FROM aliases a LEFT JOIN m ON m.entity_id = a.entity_id UNION ALL SELECT target_id, name FROM m JOIN entities e ON e.entity_id = m.entity_id) SELECT entity_id, min(alias) AS alias FROM al GROUP BY entity_id, lower(trim(regexp_replace(alias, '\\s+', ' ', 'g')))")
def merge_aliases(aliases, entities):
    return curation.merge_aliases(aliases, entities, _merges(entities))


@query("entities claims aliases", "SELECT entity_id, kind FROM entities e WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.subject_id = e.entity_id) AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.object_id = e.entity_id) AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.entity_id)")
def unreferenced_entities(entities, rows, aliases):
    return curation.unreferenced(entities, rows, aliases).select("entity_id", "kind")


@query("sources runs", "SELECT s.source_id, coalesce(n, 0) AS runs, row_number() OVER (PARTITION BY length(identifier) ORDER BY coalesce(n, 0) DESC, s.source_id) = 1 AS survives FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM runs GROUP BY source_id) r ON r.source_id = s.source_id")
def survivor_sources(sources, rows):
    return curation.survivors(sources, rows)


@query("sources", "SELECT source_id, identifier, CASE WHEN source_id = 'src1' THEN 'paused' ELSE status END AS status FROM sources UNION ALL SELECT 'new', 'n', 'active'")
def source_upsert(sources):
    old = sources.select("source_id", "identifier", "status")
    new = old.filter("source_id = 'src1'").select("source_id", F.lit(None).cast("string").alias("identifier"), F.lit("paused").alias("status"))
    more = sources.sparkSession.range(1).select(F.lit("new").alias("source_id"), F.lit("n").alias("identifier"), F.lit("active").alias("status"))
    return curation.upsert(old, new.union(more), "source_id")


@query("runs", "SELECT run_id, source_id, kind, CASE WHEN status = 'stopped' AND lead(run_id) OVER (PARTITION BY source_id, kind ORDER BY started_at, run_id) IS NOT NULL THEN 'superseded' ELSE status END AS status FROM runs")
def supersede_stopped(rows):
    return curation.supersede(rows)


@query("sources", "SELECT source_id, CASE WHEN status = 'archived' THEN 'archived' ELSE 'active' END AS status FROM sources")
def status_backfill(sources):
    return curation.status_from_notes(sources)


# Retrieval



@query("documents", "SELECT doc_id, CAST(len(list_filter(['thshed', 'wherth', 'inoror', 'leaux'], lambda t: contains(lower(text), t))) AS INT) AS hits FROM documents WHERE len(list_filter(['thshed', 'wherth', 'inoror', 'leaux'], lambda t: contains(lower(text), t))) > 0 ORDER BY doc_id DESC LIMIT 50")
def lexical_candidates(docs):
    return retrieval.lexical(docs, "what thshed about WHERTH inoror leaux thshed").select("doc_id", "hits")


@query("documents", "WITH c AS (SELECT doc_id, CAST(len(list_filter(['thshed', 'wherth', 'inoror', 'leaux'], lambda t: contains(lower(text), t))) AS INT) AS hits FROM documents WHERE len(list_filter(['thshed', 'wherth', 'inoror', 'leaux'], lambda t: contains(lower(text), t))) > 0 ORDER BY doc_id DESC LIMIT 50) SELECT * FROM c ORDER BY hits DESC, doc_id LIMIT 8")
def lexical_rank(docs):
    return retrieval.lexical_rank(docs, "what thshed about WHERTH inoror leaux thshed")


_COS = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)"


@query("embeddings", f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, e.vec_id LIMIT 8")
def cosine_top8(vectors):
    return retrieval.nearest(vectors, vectors.filter("vec_id = 7"))


@query("documents embeddings", f"WITH c AS (SELECT doc_id, CAST(len(list_filter(['thshed', 'wherth', 'inoror', 'leaux'], lambda t: contains(lower(text), t))) AS INT) AS hits FROM documents WHERE len(list_filter(['thshed', 'wherth', 'inoror', 'leaux'], lambda t: contains(lower(text), t))) > 0 ORDER BY doc_id DESC LIMIT 50), s AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) SELECT doc_id, hits, coalesce(score, 0.0) AS score FROM c LEFT JOIN s ON s.vec_id = doc_id ORDER BY hits DESC, score DESC, doc_id LIMIT 8")
def hybrid_rank(docs, vectors):
    return retrieval.hybrid(docs, vectors, vectors.filter("vec_id = 7"), "thshed WHERTH inoror leaux")


@query("documents embeddings", f"WITH c AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1000), s AS (SELECT e.vec_id, max({_COS}) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id IN (7, 11)) q GROUP BY e.vec_id) SELECT doc_id, 0 AS hits, coalesce(score, 0.0) AS score FROM c LEFT JOIN s ON s.vec_id = doc_id ORDER BY score DESC, doc_id LIMIT 8")
def hybrid_fallback(docs, vectors):
    """No document holds a term of the question; two variants of it have vectors."""
    return retrieval.hybrid(docs, vectors, vectors.filter("vec_id in (7, 11)"), "zzqqxx wwvvkk")


@query("links fetches", "SELECT document_id, fetch_id, source_id, url FROM (SELECT l.document_id, f.*, row_number() OVER (PARTITION BY l.document_id ORDER BY fetched_at DESC, f.fetch_id DESC) AS n FROM links l JOIN fetches f ON f.fetch_id = l.fetch_id) x WHERE n = 1")
def document_latest_fetch(links, fetches):
    return retrieval.latest_fetch(links, fetches)


@query("links fetches", "WITH x AS (SELECT document_id, url FROM (SELECT l.document_id, f.*, row_number() OVER (PARTITION BY l.document_id ORDER BY fetched_at DESC, f.fetch_id DESC) AS n FROM links l JOIN fetches f ON f.fetch_id = l.fetch_id) y WHERE n = 1) SELECT min(document_id) AS document_id, url FROM x GROUP BY url ORDER BY url LIMIT 8")
def citation_dedup(links, fetches):
    return retrieval.citations(retrieval.latest_fetch(links, fetches)).select("document_id", "url")


@query("conversations", "SELECT conv_id, turn, role, left(text, CASE WHEN role = 'assistant' THEN 12000 ELSE 4000 END) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations WHERE trim(text) <> '') x WHERE n <= 6")
def ask_history(turns):
    return retrieval.history(turns)


# Scalars and text


@query("benchmark", "SELECT item_id, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i), ' ') AS terms FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{3,}'), lambda t: NOT regexp_matches(t, '^(about|from|have|wh(at|en|ere|ich|ile|o)|work(ed)?|with)$')) AS w FROM benchmark) x")
def query_terms(items):
    return items.select("item_id", F.array_join(scalars.query_terms(F.col("text")), " ").alias("terms"))


@query("pages", "WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]), '^(utm_(source|medium|campaign|term|content)|(fb|g|ms|y)cl(id|kid)|msclkid|mc_[ce]id|_ga)$')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE concat(p, '=') END)) AS pairs FROM pages) SELECT page_id, concat(scheme, '://', CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(pairs) > 0 THEN concat('?', array_to_string(pairs, '&')) ELSE '' END) AS url FROM u")
def url_canonicalize(pages):
    return pages.select("page_id", scalars.canonical_url(F.col("url")).alias("url"))


@query("pages", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') LIKE '%.example.com' AS in_scope FROM pages")
def host_scope(pages):
    return pages.select("page_id", scalars.root_host(F.col("url")).alias("host"), scalars.in_scope(F.col("url"), F.lit("example.com")).alias("in_scope"))


@query("part", "SELECT p_partkey, trim(regexp_replace(lower(concat('--', p_name, ' ', p_brand)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(concat('--', p_name, ' ', p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS header FROM part")
def slugs(part):
    name = F.concat(F.lit("--"), "p_name", F.lit(" "), "p_brand")
    return part.select("p_partkey", scalars.slug(name).alias("slug"), scalars.header_key(name).alias("header"))


@query("documents", "SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g')) AS cleaned FROM documents")
def whitespace_collapse(docs):
    return docs.select("doc_id", scalars.collapsed(F.col("text")).alias("cleaned"))


@query("customer", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1950 + c_custkey % 70 WHEN c_custkey % 100 >= 50 THEN 1900 + c_custkey % 100 ELSE 2000 + c_custkey % 100 END AS INT) AS year FROM customer")
def class_year(customer):
    two = F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Class of "), (1950 + F.col("c_custkey") % 70).cast("string"))).otherwise(F.concat(F.lit("T'"), two))
    return customer.select("c_custkey", scalars.class_year(text).alias("year"))


@query("documents", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def content_digest(docs):
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


@query("pages")
def html_to_text(pages):
    return pages.select("page_id", scalars.title_of(F.col("html")).alias("title"), scalars.without_tail(scalars.without_tags(F.col("html"))).alias("text"))


@query("pages")
def link_discovery(pages):
    return crawl.links(pages)


@query("pages")
def crawl_frontier(pages):
    return crawl.frontier(pages, depth=2, cap=5000)


@query("documents")
def pattern_claims(docs):
    return extraction.extract(docs)


@query("documents")
def snippets(docs):
    return docs.select("doc_id", scalars.snippet(F.col("text"), "the").alias("snippet")).filter("snippet is not null")


# Extensions: event-time windows, which the data model has room for


@query("events", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_hourly(events):
    return streams.hourly(events)
