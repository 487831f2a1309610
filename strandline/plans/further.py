"""Claim-graph queries on provenance, names, review, upkeep and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import answers, claims, coverage, crawl, graph, maintenance, names, provenance, review, runs
from ..sources import tables
from ..streaming import streams
from .bridge import NOW
from .queries import _ONE, ORACLES, PENDING, QUERIES, _CHAIN, OK_2XX, query  # noqa: F401

_BEHIND = "behind AS (SELECT DISTINCT l.document_id, r.source_id FROM links l JOIN fetches f ON f.fetch_id = l.fetch_id JOIN fetch_runs r ON r.run_id = f.run_id JOIN document_rows d ON d.document_id = l.document_id)"

# Provenance


@query("evidence quotes document_rows links fetches fetch_runs", f"WITH {_BEHIND} SELECT b.source_id, count(DISTINCT e.claim_id) AS claims FROM evidence e JOIN quotes q ON q.raw_id = e.raw_id JOIN behind b ON b.document_id = q.document_id GROUP BY b.source_id")
def provenance_claims(evidence, raws, documents, links, fetches, fetch_runs):
    return provenance.claims_per_source(evidence, raws, provenance.document_sources(documents, links, fetches, fetch_runs))


@query("mentions quotes document_rows links fetches fetch_runs", f"WITH {_BEHIND} SELECT b.source_id, count(DISTINCT m.entity_id) AS entities FROM mentions m JOIN quotes q ON q.raw_id = m.raw_id JOIN behind b ON b.document_id = q.document_id GROUP BY b.source_id")
def provenance_entities(mentions, raws, documents, links, fetches, fetch_runs):
    return provenance.entities_per_source(mentions, raws, provenance.document_sources(documents, links, fetches, fetch_runs))


_ORIGIN = "origin AS (SELECT q.raw_id, q.document_id, q.quote, q.added_at, f.url, f.fetched_at, r.source_id, s.identifier AS source_name FROM quotes q LEFT JOIN document_rows d ON d.document_id = q.document_id LEFT JOIN fetches f ON f.fetch_id = d.document_id LEFT JOIN fetch_runs r ON r.run_id = f.run_id LEFT JOIN sources s ON s.source_id = r.source_id)"


@query("quotes document_rows fetches fetch_runs sources", f"WITH {_ORIGIN} SELECT raw_id, document_id, quote, url, source_name FROM origin ORDER BY added_at DESC, raw_id LIMIT 500 OFFSET 500")
def raw_claims_page(raws, documents, fetches, fetch_runs, sources):
    rows = provenance.raw_origins(raws, documents, fetches, fetch_runs, sources)
    return claims.page(rows, 2, 500, 5000, F.desc("added_at"), F.col("raw_id")).select("raw_id", "document_id", "quote", "url", "source_name")


@query("quotes document_rows fetches fetch_runs sources", f"WITH {_ORIGIN} SELECT source_name, count(*) AS raws, count(url) AS fetched FROM origin GROUP BY source_name")
def raw_claim_origins(raws, documents, fetches, fetch_runs, sources):
    return provenance.raw_origins(raws, documents, fetches, fetch_runs, sources).groupBy("source_name").agg(F.count("*").alias("raws"), F.count("url").alias("fetched"))


@query("evidence quotes document_rows links fetches fetch_runs", "WITH x AS (SELECT e.claim_id, e.source_id, e.raw_id, q.document_id, f.fetch_id, f.url, row_number() OVER (PARTITION BY e.claim_id, e.source_id, e.raw_id, q.document_id ORDER BY f.fetched_at DESC, f.fetch_id DESC) AS n FROM evidence e JOIN quotes q ON q.raw_id = e.raw_id JOIN document_rows d ON d.document_id = q.document_id JOIN links l ON l.document_id = d.document_id JOIN fetches f ON f.fetch_id = l.fetch_id JOIN fetch_runs r ON r.run_id = f.run_id AND r.source_id = e.source_id) SELECT claim_id, source_id, raw_id, document_id, fetch_id, url FROM x WHERE n = 1")
def claim_evidence_chain(evidence, raws, documents, links, fetches, fetch_runs):
    return provenance.claim_backing(evidence, raws, documents, links, fetches, fetch_runs).drop("added_at")


@query("evidence quotes document_rows fetches", "WITH x AS (SELECT e.claim_id, q.document_id, e.source_id, e.added_at, row_number() OVER (PARTITION BY e.claim_id, q.document_id ORDER BY e.added_at DESC, e.source_id DESC) AS n FROM evidence e JOIN quotes q ON q.raw_id = e.raw_id JOIN document_rows d ON d.document_id = q.document_id), k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY added_at DESC, document_id) AS rank FROM x WHERE n = 1) SELECT k.claim_id, k.document_id, k.source_id, f.url, k.rank FROM k JOIN fetches f ON f.fetch_id = k.document_id WHERE rank <= 3")
def claim_first_seen_top3(evidence, raws, documents, fetches):
    return provenance.first_seen_documents(evidence, raws, documents, fetches)


@query("evidence quotes links fetches", "SELECT q.document_id, f.url, max(f.fetched_at) AS newest FROM (SELECT DISTINCT q.document_id FROM evidence e JOIN quotes q ON q.raw_id = e.raw_id WHERE e.claim_id IN (SELECT min(claim_id) FROM evidence)) q LEFT JOIN links l ON l.document_id = q.document_id LEFT JOIN fetches f ON f.fetch_id = l.fetch_id GROUP BY q.document_id, f.url")
def claim_documents_newest(evidence, raws, links, fetches):
    return provenance.latest_by_url(evidence.join(F.broadcast(evidence.agg(F.min("claim_id").alias("claim_id"))), "claim_id", "left_semi"), raws, links, fetches)


@query("evidence sources", "SELECT e.claim_id, count(DISTINCT coalesce(e.source_id, s.identifier)) AS labels FROM evidence e LEFT JOIN sources s ON s.source_id = e.source_id GROUP BY e.claim_id")
def claim_source_labels(evidence, sources):
    named = evidence.select("claim_id", "source_id").distinct().join(F.broadcast(sources.select("source_id", "identifier")), "source_id", "left")
    return named.groupBy("claim_id").agg(F.countDistinct(F.coalesce("source_id", "identifier")).alias("labels"))


@query("document_rows fetches fetch_runs sources", "SELECT d.document_id, d.content_hash, f.url, r.source_id, s.identifier FROM document_rows d LEFT JOIN fetches f ON f.fetch_id = d.document_id LEFT JOIN fetch_runs r ON r.run_id = f.run_id LEFT JOIN sources s ON s.source_id = r.source_id WHERE d.document_id = 17")
def document_detail(documents, fetches, fetch_runs, sources):
    one = tables.lookup(documents, "document_id", 17).withColumn("fetch_id", F.col("document_id"))
    return one.join(fetches.select("fetch_id", "url", "run_id"), "fetch_id", "left").join(fetch_runs.select("run_id", "source_id"), "run_id", "left").join(sources.select("source_id", "identifier"), "source_id", "left").select("document_id", "content_hash", "url", "source_id", "identifier")


@query("claims entities evidence", "WITH e AS (SELECT claim_id, count(DISTINCT raw_id) AS evidence_count FROM evidence GROUP BY claim_id), hit AS (SELECT c.*, s.name AS subject_name, o.name AS object_name FROM claims c JOIN entities s ON s.entity_id = c.subject_id LEFT JOIN entities o ON o.entity_id = c.object_id WHERE valid_to IS NULL AND predicate = 'founded'), t AS (SELECT count(*) AS total FROM hit), d AS (SELECT claim_id, document_id, max(added_at) AS seen FROM evidence GROUP BY claim_id, document_id), k AS (SELECT claim_id, document_id, row_number() OVER (PARTITION BY claim_id ORDER BY seen DESC, document_id) AS rank FROM d), src AS (SELECT claim_id, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY rank) AS documents FROM k WHERE rank <= 3 GROUP BY claim_id), p AS (SELECT * FROM hit ORDER BY first_seen_at DESC, claim_id LIMIT 50) SELECT p.claim_id, subject_name, object_name, coalesce(evidence_count, 0) AS evidence_count, documents, total FROM p CROSS JOIN t LEFT JOIN e ON e.claim_id = p.claim_id LEFT JOIN src ON src.claim_id = p.claim_id")
def claim_list_rows(rows, entities, evidence):
    """A page of claims with evidence counts, their newest documents and the total of the filter."""
    named = claims.with_endpoints(claims.by_status(rows.filter("predicate = 'founded'"), "current"), entities)
    page = claims.page(named, 1, 50, 200, F.desc("first_seen_at"), F.col("claim_id")).select("claim_id", "subject_name", "object_name")
    # At most 200 claims: their evidence alone is grouped.
    own = evidence.join(F.broadcast(page.select("claim_id")), "claim_id", "left_semi")
    newest = claims.newest_documents(own).groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"].cast("string")), ",").alias("documents"))
    out = page.join(claims.evidence_counts(own), "claim_id", "left").join(newest, "claim_id", "left").join(named.agg(F.count("*").alias("total")))  # one row
    return out.select("claim_id", "subject_name", "object_name", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "documents", "total")


# Names


@query("people", "SELECT person_id, fine AS valid, CASE WHEN led THEN 'Ida Lindqvist' ELSE name END AS bare, led AS changed FROM people")
def name_check(people):
    led = names.headline_stripped(F.col("name"))
    return people.select("person_id", names.valid_name(led["text"], F.lit("person")).alias("valid"), led["text"].alias("bare"), led["changed"].alias("changed"))


@query("extracted", "SELECT raw_id, CASE WHEN raw_id % 17 = 0 THEN 'invalid_predicate' WHEN raw_id % 13 = 0 THEN 'invalid_subject_type' WHEN raw_id % 23 = 0 THEN 'empty_quote' WHEN NOT fine THEN 'invalid_subject' WHEN raw_id % 19 = 0 THEN 'invalid_object' END AS reason, led AS rewritten FROM extracted")
def raw_claim_check(extracted):
    return names.validated(extracted).select("raw_id", "reason", "rewritten")


@query("extracted", "WITH r AS (SELECT *, CASE WHEN raw_id % 17 = 0 OR raw_id % 13 = 0 OR raw_id % 23 = 0 OR NOT fine OR raw_id % 19 = 0 THEN 1 ELSE 0 END AS bad FROM extracted) SELECT 'accepted' AS part, count(*) AS rows FROM r WHERE bad = 0 UNION ALL SELECT 'audit', count(*) FROM r WHERE bad = 1 OR led")
def raw_claim_sink(extracted):
    accepted, audit = names.split_claims(names.validated(extracted))
    return accepted.agg(F.lit("accepted").alias("part"), F.count("*").alias("rows")).union(audit.agg(F.lit("audit").alias("part"), F.count("*").alias("rows")))


@query("people mentions", "SELECT p.entity_id, p.name, CASE WHEN EXISTS (SELECT 1 FROM mentions m WHERE m.entity_id = p.entity_id AND m.mention_id % 9 = 0) THEN 'flag' ELSE 'archive' END AS action FROM people p WHERE NOT (fine AND NOT led)")
def invalid_people(people, mentions):
    # "Meet Ida Lindqvist" has the shape of a name of three words; only the stored name counts here.
    found = names.invalid_people(people.select("entity_id", "name", F.lit("person").alias("kind")), mentions.filter("mention_id % 9 = 0"))
    return found.unionByName(people.filter("led").join(mentions.filter("mention_id % 9 = 0").select("entity_id").distinct().withColumn("used", F.lit(True)), "entity_id", "left").select("entity_id", "name", F.when(F.col("used"), "flag").otherwise("archive").alias("action")))


@query("part", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Director of the Harbor' WHEN 1 THEN 'Head and Chair' ELSE 'Dean' END AS title FROM part")
def title_forms(part):
    text = F.when(F.col("p_partkey") % 3 == 0, "  DIRECTOR  Of THE harbor.").when(F.col("p_partkey") % 3 == 1, "head And chair;").otherwise("dean")
    return part.select("p_partkey", names.title_form(text).alias("title"))


@query("customer", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1987' WHEN 1 THEN '2004' WHEN 2 THEN 'no year' ELSE 'T''98' END AS object_text FROM customer")
def class_year_repair(customer):
    k = F.col("c_custkey") % 4
    rows = customer.select("c_custkey", F.when(k == 3, "founded").otherwise("class_year").alias("predicate"), F.when(k == 0, "Class of 1987").when(k == 1, "unclear").when(k == 2, "no year").otherwise("T'98").alias("object_text"), F.when(k == 1, "she is a T'04").otherwise("nothing").alias("raw_quote"))
    return names.repaired_years(rows, scalars.class_year).select("c_custkey", "object_text")


# Review


@query("candidates mentions flagged", "SELECT review_decision, count(*) AS rows FROM candidates GROUP BY review_decision")
def review_counts(candidates, mentions, flagged):
    return review.queue(candidates, mentions, flagged, "all").groupBy("review_decision").agg(F.count("*").alias("rows"))


_LOW = "SELECT c.* FROM candidates c WHERE review_decision IS NULL AND mention_id IN (SELECT m.mention_id FROM mentions m JOIN flagged f ON f.entity_id = m.entity_id WHERE f.needs_review)"


@query("candidates mentions flagged", f"SELECT candidate_id, score FROM ({_LOW}) x ORDER BY score DESC NULLS LAST, created_at DESC, candidate_id LIMIT 100 OFFSET 50")
def review_queue(candidates, mentions, flagged):
    return review.ordered(review.queue(candidates, mentions, flagged, low_signal=True), 50, 100).select("candidate_id", "score")


@query("candidates mentions flagged", "SELECT c.candidate_id, c.candidate_entity_id, e.name AS candidate_name, coalesce(m.entity_id, CASE WHEN e.needs_review THEN c.candidate_entity_id END) AS source_entity_id, s.name AS source_name FROM candidates c LEFT JOIN mentions m ON m.mention_id = c.mention_id LEFT JOIN flagged e ON e.entity_id = c.candidate_entity_id LEFT JOIN flagged s ON s.entity_id = coalesce(m.entity_id, CASE WHEN e.needs_review THEN c.candidate_entity_id END)")
def review_rows(candidates, mentions, flagged):
    return review.rows_of(candidates, mentions, flagged)


@query("candidates", "SELECT candidate_id, coalesce(review_decision, CASE WHEN candidate_id % 3 = 0 THEN 'split' WHEN candidate_id % 3 = 1 THEN 'merge' END) AS review_decision, review_decision IS NOT NULL AND candidate_id % 3 <> 2 AS refused FROM candidates")
def review_decide(candidates):
    told = candidates.filter("candidate_id % 3 <> 2").select("candidate_id", F.when(F.col("candidate_id") % 3 == 0, "confirm").otherwise("merge").alias("decision"))
    return review.decided(candidates, told)


@query("candidates people", "SELECT c.candidate_id, c.candidate_entity_id, p.name AS candidate_name, 'split' AS review_decision, 'auto' AS reviewed_by FROM candidates c JOIN people p ON p.entity_id = c.candidate_entity_id WHERE review_decision IS NULL AND NOT fine")
def review_auto_split(candidates, people):
    return review.auto_split(candidates, people.select("entity_id", F.lit("person").alias("kind"), "name"))


@query("summaries claims entities", "WITH v AS (SELECT subject_id AS entity_id, predicate, coalesce(o.name, object_value) AS value, min(claim_id) AS first FROM claims LEFT JOIN entities o ON o.entity_id = object_id WHERE predicate IN ('employed_by', 'founded') AND coalesce(o.name, object_value) IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT entity_id, predicate, first_value, -1 FROM summaries) SELECT entity_id, predicate, string_agg(value, '|' ORDER BY first, value) AS values FROM v GROUP BY entity_id, predicate")
def review_qualifiers(summaries, rows, entities):
    seeds = summaries.select("entity_id", "predicate", F.array("first_value").alias("seed"))
    return review.qualifiers(seeds, rows, entities).select("entity_id", "predicate", F.array_join("values", "|").alias("values"))


@query("claims", "SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, bool_and(claim_id % 11 <> 0) AS resolved FROM claims WHERE object_id IS NOT NULL GROUP BY 1, 2")
def edge_resolved(rows):
    marked = rows.filter("object_id is not null").withColumn("qualifiers", F.when(F.col("claim_id") % 11 == 0, '{"is_resolved": false}').otherwise('{"is_resolved": true}'))
    fine = F.coalesce(F.get_json_object("qualifiers", "$.is_resolved") != "false", F.lit(True))
    return marked.groupBy(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).agg(F.bool_and(fine).alias("resolved"))


@query("claims entities", "SELECT subject_id, predicate, string_agg(concat(CAST(claim_id AS VARCHAR), ':', coalesce(o.name, object_value)), '|' ORDER BY claim_id, coalesce(o.name, object_value)) AS entries FROM claims LEFT JOIN entities o ON o.entity_id = object_id WHERE subject_id IN ('s1', 's2', 's3') GROUP BY subject_id, predicate")
def claims_by_predicate(rows, entities):
    target = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"))
    named = rows.filter(F.col("subject_id").isin("s1", "s2", "s3")).join(target, "object_id", "left")
    lists = named.groupBy("subject_id", "predicate").agg(F.array_sort(F.collect_list(F.struct("claim_id", F.coalesce("object_name", "object_value").alias("value")))).alias("entries"))
    return lists.select("subject_id", "predicate", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["claim_id"].cast("string"), e["value"])), "|").alias("entries"))


# Upkeep and sinks


@query("fetches", "SELECT fetch_id, coalesce(CASE WHEN fetch_id % 2 = 0 THEN sha256(body) END, sha256(body)) AS content_hash FROM fetches")
def hash_backfill(fetches):
    return maintenance.with_hashes(fetches.withColumn("content_hash", F.when(F.col("fetch_id") % 2 == 0, F.sha2("body", 256)))).select("fetch_id", "content_hash")


@query("fetches document_rows", "SELECT h AS content_hash, coalesce(k.document_id, fresh) AS document_id, k.document_id IS NULL AS created FROM (SELECT sha256(body) AS h, min(fetch_id) AS fresh FROM fetches WHERE body IS NOT NULL GROUP BY 1) n LEFT JOIN (SELECT * FROM document_rows WHERE document_id % 3 <> 0) k ON k.content_hash = n.h")
def document_get_or_create(fetches, known):
    new = fetches.filter("body is not null").select(F.sha2("body", 256).alias("content_hash"), F.col("fetch_id").alias("document_id"))
    return maintenance.created_documents(known.filter("document_id % 3 <> 0"), new)


@query("run_events", "SELECT run_id, arg_max(status, seq) AS status, arg_max(error, seq) FILTER (WHERE error IS NOT NULL) AS error, arg_max(stats, seq) FILTER (WHERE stats IS NOT NULL) AS stats, max(seq) AS updates FROM run_events GROUP BY run_id")
def run_partial_updates(events):
    return maintenance.run_states(events)


@query("runs", "SELECT run_id, CASE WHEN run_id % 2 = 0 THEN concat('{\"depth\":\"2\",\"kind\":\"', kind, '\",\"max\":\"', CAST(run_id % 7 AS VARCHAR), '\"}') ELSE concat('{\"depth\":\"1\",\"kind\":\"', kind, '\"}') END AS spec FROM runs")
def run_spec_merge(rows):
    old = F.to_json(F.struct(F.lit("1").alias("depth"), "kind"))
    new = F.when(F.col("run_id") % 2 == 0, F.to_json(F.struct(F.lit("2").alias("depth"), (F.col("run_id") % 7).cast("string").alias("max"))))
    return rows.select("run_id", maintenance.merged_spec(old, new).alias("spec"))


@query("runs", f"SELECT 'run.auto_failed_stale' AS action, 'runs' AS target_table, CAST(run_id AS VARCHAR) AS target_id, concat('{{\"source_id\":\"', source_id, '\"}}') AS payload FROM runs WHERE status = 'running' AND coalesce(stats_updated_at, started_at) < {NOW} - 1800")
def audit_append(rows):
    return maintenance.audit(runs.stale(rows, NOW), "run.auto_failed_stale", "runs", "run_id", "source_id")


@query("runs", "SELECT action, count(*) AS rows FROM (SELECT concat('run.', status) AS action FROM runs) x WHERE action LIKE 'run.s%' GROUP BY action")
def audit_like(rows):
    marked = rows.select(F.concat(F.lit("run."), "status").alias("action"))
    return marked.filter(F.col("action").like("run.s%")).groupBy("action").agg(F.count("*").alias("rows"))


@query("fetches fetch_runs", "SELECT CASE WHEN source_id IN ('src1', 'src2') OR source_id IS NULL THEN 'unknown_run' WHEN fetch_id % 31 = 0 THEN 'missing_url' ELSE 'written' END AS part, count(*) AS rows FROM fetches GROUP BY 1")
def fetch_quarantine(fetches, fetch_runs):
    rows = fetches.withColumn("url", F.when(F.col("fetch_id") % 31 != 0, F.col("url")))
    good, bad = maintenance.quarantined(rows, fetch_runs.filter("source_id not in ('src1', 'src2')"))
    return good.select(F.lit("written").alias("part")).unionByName(bad.select(F.col("reason").alias("part"))).groupBy("part").agg(F.count("*").alias("rows"))


@query("claims", "SELECT subject_id, predicate, object_id, claim_id, CASE WHEN claim_id % 2 = 0 THEN 'new' ELSE 'old' END AS qualifiers FROM claims WHERE object_id IS NOT NULL UNION ALL SELECT 'fresh', 'founded', 'p1', -1, 'new'")
def claim_get_or_create(rows):
    """Existing claims get their qualifiers refreshed, missing ones are added; ids tell rows of one triple apart."""
    old = rows.filter("object_id is not null").select("subject_id", "predicate", "object_id", "claim_id", F.lit("old").alias("qualifiers"))
    more = rows.sparkSession.range(1).select(F.lit("fresh").alias("subject_id"), F.lit("founded").alias("predicate"), F.lit("p1").alias("object_id"), F.lit(-1).cast("long").alias("claim_id"), F.lit("new").alias("qualifiers"))
    return maintenance.get_or_create(old, old.filter("claim_id % 2 = 0").withColumn("qualifiers", F.lit("new")).unionByName(more), ["subject_id", "predicate", "object_id", "claim_id"], ["qualifiers"])


@query("runs", "SELECT source_id, CAST(sum(CAST(items AS DECIMAL(18, 6))) AS DECIMAL(10, 4)) AS cost, count(*) AS claims FROM runs WHERE status IN ('complete', 'failed') GROUP BY source_id")
def extractor_close(rows):
    """Cost and claims of each source; as wide as the sum itself, since the column of (10, 4) overflows at a million."""
    done = rows.filter(F.col("status").isin("complete", "failed"))
    return done.groupBy("source_id").agg(F.sum(F.col("items").cast("decimal(18,6)")).cast("decimal(26,4)").alias("cost"), F.count("*").alias("claims"))


_COUNTED = f"counted AS (SELECT s.source_id, coalesce(p.n, 0) AS pages, coalesce(u.n, 0) AS urls FROM sources s LEFT JOIN (SELECT source_id, count(DISTINCT url) AS n FROM fetches WHERE {OK_2XX} AND (body IS NOT NULL OR body_unchanged_since IS NOT NULL) GROUP BY source_id) p ON p.source_id = s.source_id LEFT JOIN (SELECT source_id, count(DISTINCT url) AS n FROM fetches GROUP BY source_id) u ON u.source_id = s.source_id)"


@query("stored_counters sources fetches", f"WITH {_COUNTED} SELECT k.source_id, CASE WHEN k.pages <> c.pages OR k.urls <> c.urls THEN c.pages ELSE k.pages END AS pages, CASE WHEN k.pages <> c.pages OR k.urls <> c.urls THEN greatest(c.urls, c.pages) ELSE k.urls END AS urls, k.pages <> c.pages OR k.urls <> c.urls AS corrected FROM stored_counters k JOIN counted c ON c.source_id = k.source_id")
def counters_refresh(stored, sources, fetches):
    return maintenance.reconciled_counters(stored, sources, fetches)


@query("sources stored_counters runs fetches links document_rows", f"""WITH {_CHAIN}, {_COUNTED}
SELECT 'sources' AS measure, (SELECT count(*) FROM sources) AS n UNION ALL SELECT 'stale_runs_failed', (SELECT count(*) FROM runs WHERE status = 'running' AND coalesce(stats_updated_at, started_at) < {NOW} - 1800 AND source_id IN (SELECT source_id FROM sources))
UNION ALL SELECT 'dangling_links_deleted', (SELECT count(*) FROM (SELECT DISTINCT document_id, fetch_id FROM links WHERE document_id NOT IN (SELECT document_id FROM document_rows) OR fetch_id NOT IN (SELECT fetch_id FROM fetches)) x)
UNION ALL SELECT 'orphan_documents_flagged', (SELECT count(*) FROM document_rows d WHERE valid_from < {NOW} - 604800 AND NOT EXISTS (SELECT 1 FROM links l WHERE l.document_id = d.document_id))
UNION ALL SELECT 'broken_body_chains', (SELECT count(*) FROM chains WHERE state = 'broken')
UNION ALL SELECT 'counters_corrected', (SELECT count(*) FROM stored_counters k JOIN counted c ON c.source_id = k.source_id WHERE k.pages <> c.pages OR k.urls <> c.urls)
UNION ALL SELECT 'pending_parse_sources', (SELECT count(DISTINCT source_id) FROM ({PENDING}) p WHERE source_id IN (SELECT source_id FROM sources))""")
def reconcile_report(sources, stored, rows, fetches, links, documents):
    return maintenance.reconcile(sources, stored, rows, fetches, links, documents, NOW)


@query("fetches links", f"SELECT fetch_id FROM ({PENDING}) p WHERE fetch_id % 4 = 1 ORDER BY fetched_at, fetch_id LIMIT 100")
def pending_of_given_ids(fetches, links):
    ids = fetches.filter("fetch_id % 4 = 1").select("fetch_id")
    return coverage.in_order(coverage.pending(fetches, links, ids=ids)).select("fetch_id").limit(100)


@query("quotes", "SELECT document_id, count(*) AS raws FROM quotes WHERE document_id IN (3, 5, 8) GROUP BY document_id")
def delete_row_counts(raws):
    return raws.filter(F.col("document_id").isin(3, 5, 8)).groupBy("document_id").agg(F.count("*").alias("raws"))


@query("runs", "SELECT source_id, run_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs WHERE status IN ('queued', 'running')) x WHERE n = 1")
def newest_active_run(rows):
    return runs.newest_active(rows)


@query("runs", "SELECT count(*) > 0 AS running FROM runs WHERE run_id = 7 AND status = 'running'")
def run_is_running(rows):
    return runs.is_running(rows, 7).agg((F.count("*") > 0).alias("running"))


@query("runs", "SELECT r.source_id, count(*) AS let_through FROM runs r LEFT JOIN (SELECT source_id, min(run_id) AS stop FROM runs WHERE status = 'stopped' GROUP BY source_id) s ON s.source_id = r.source_id WHERE s.stop IS NULL OR r.run_id < s.stop GROUP BY r.source_id")
def stop_checks(rows):
    return runs.until_stopped(rows).groupBy("source_id").agg(F.count("*").alias("let_through"))


@query("sources stored_counters fetches", f"WITH {_COUNTED} SELECT k.source_id, greatest(k.pages, c.pages) AS pages_shown, round(least(100.0, 100.0 * c.pages / greatest(c.urls, 1)), 1) AS percent FROM stored_counters k JOIN counted c ON c.source_id = k.source_id")
def shown_counters(sources, stored, fetches):
    known = sources.select("source_id").join(coverage.pages_fetched(fetches), "source_id", "left").join(coverage.urls_known(fetches), "source_id", "left").fillna(0)
    return stored.join(known, "source_id").select("source_id", F.greatest("pages", "pages_fetched").alias("pages_shown"), runs.percent(F.col("pages_fetched"), F.col("urls_known")).alias("percent"))


@query("runs", "SELECT source_id, max(items) AS slowest FROM runs WHERE items IS NOT NULL GROUP BY source_id")
def max_throttle(rows):
    """The largest delay over the kinds of work of each source, from a map a source."""
    maps = rows.filter("items is not null").groupBy("source_id", "kind").agg(F.max("items").alias("d")).groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "d"))).alias("m"))
    return maps.select("source_id", F.array_max(F.map_values("m")).alias("slowest"))


@query("runs", "SELECT run_id, source_id FROM (SELECT run_id, source_id, started_at FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 200) x ORDER BY started_at, run_id")
def log_replay_200(rows):
    return runs.newest(rows, 200).orderBy("started_at", "run_id").select("run_id", "source_id")


@query("runs", "SELECT run_id, concat('data: {\"run_id\":', CAST(run_id AS VARCHAR), ',\"status\":\"', status, '\"}', chr(10), chr(10)) AS frame FROM runs")
def event_frames(rows):
    framed = streams.server_sent(rows.select("run_id", "status"))
    return framed.select(F.get_json_object(F.regexp_extract("frame", r"^data: (.*)\n\n$", 1), "$.run_id").cast("long").alias("run_id"), "frame")


# Answers

_TERMS = "['widget', 'ring']"


@query("claims entities evidence quotes documents", "WITH hit AS (SELECT DISTINCT c.claim_id, c.first_seen_at FROM claims c LEFT JOIN entities s ON s.entity_id = c.subject_id LEFT JOIN entities o ON o.entity_id = c.object_id LEFT JOIN evidence e ON e.claim_id = c.claim_id LEFT JOIN quotes q ON q.raw_id = e.raw_id LEFT JOIN documents d ON d.doc_id = q.document_id WHERE regexp_matches(lower(coalesce(s.name, '')), 'widget|thshed') OR regexp_matches(lower(coalesce(o.name, '')), 'widget|thshed') OR regexp_matches(lower(coalesce(object_value, '')), 'widget|thshed') OR regexp_matches(lower(coalesce(q.quote, '')), 'widget|thshed') OR regexp_matches(lower(coalesce(d.text, '')), 'widget|thshed')) SELECT claim_id FROM hit ORDER BY first_seen_at DESC, claim_id LIMIT 30")
def claims_for_question(rows, entities, evidence, raws, documents):
    terms = scalars.query_terms(F.lit("which WIDGET worked with thshed"))
    return answers.claims_for_question(rows, entities, evidence, raws, documents.select(F.col("doc_id").alias("document_id"), "text"), terms, 30).select("claim_id")


@query("documents links fetches")
def document_citations(documents, links, fetches):
    from ..operators import retrieval

    latest = retrieval.latest_fetch(links, fetches)
    return answers.document_citations(documents.select(F.col("doc_id").alias("document_id"), "text"), latest, scalars.query_terms(F.lit("thshed inoror about leaux")))


@query("links fetches evidence", "WITH x AS (SELECT l.document_id, f.url, row_number() OVER (PARTITION BY l.document_id ORDER BY fetched_at DESC, f.fetch_id DESC) AS n FROM links l JOIN fetches f ON f.fetch_id = l.fetch_id), u AS (SELECT document_id, url FROM x WHERE n = 1), c AS (SELECT claim_id AS place, e.document_id, url, 0 AS part FROM (SELECT DISTINCT claim_id, document_id FROM evidence WHERE claim_id < 400) e JOIN u ON u.document_id = e.document_id UNION ALL SELECT document_id, document_id, url, 1 FROM u), o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY part, place, document_id) AS r FROM c) SELECT part, place, document_id, url FROM o WHERE r = 1 ORDER BY part, place, document_id LIMIT 40")
def answer_citations(links, fetches, evidence):
    from ..operators import retrieval

    latest = retrieval.latest_fetch(links, fetches).select("document_id", "url")
    own = evidence.filter("claim_id < 400").select("claim_id", "document_id").distinct().join(latest, "document_id").select(F.col("claim_id").alias("place"), "document_id", "url")
    return answers.citations(own, latest.select(F.col("document_id").alias("place"), "document_id", "url"), 40).select("part", "place", "document_id", "url")


@query("customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('who is class of ', CAST(1950 + c_custkey % 70 AS VARCHAR), '|who is T''', lpad(CAST((1950 + c_custkey % 70) % 100 AS VARCHAR), 2, '0'), '|who is ', CAST(1950 + c_custkey % 70 AS VARCHAR)) ELSE 'no year here' END AS variants FROM customer")
def year_variants(customer):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("who is class of "), (1950 + F.col("c_custkey") % 70).cast("string"))).otherwise("no year here")
    return customer.select("c_custkey", F.array_join(answers.year_variants(text), "|").alias("variants"))


@query("conversations", "SELECT conv_id, turn, concat('{\"question\":\"', CASE WHEN turn % 2 = 0 THEN 'what is it' ELSE 'and now' END, '\"}') AS key FROM conversations")
def question_keys(turns):
    text = F.when(F.col("turn") % 2 == 0, "  What IS\n it ").otherwise("And  now")
    return turns.select("conv_id", "turn", scalars.question_key(text).alias("key"))


@query("runs", "WITH o AS (SELECT run_id, concat_ws(':', source_id, kind) AS key, started_at AS tick, row_number() OVER (PARTITION BY concat_ws(':', source_id, kind) ORDER BY started_at, run_id) AS n FROM runs), s AS (SELECT run_id, key, n, tick AS made, false AS hit FROM o WHERE n = 1 UNION ALL SELECT o.run_id, o.key, o.n, CASE WHEN o.tick - s.made < 3600 THEN s.made ELSE o.tick END, o.tick - s.made < 3600 FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1) SELECT run_id AS request_id, hit FROM s")
def answer_cache(rows):
    return answers.cached(rows.select(F.col("run_id").alias("request_id"), F.concat_ws(":", "source_id", "kind").alias("key"), F.col("started_at").alias("at")))


@query("embeddings", "SELECT vec_id, len(coalesce(embedding, [])) AS size FROM embeddings")
def vector_coercion(vectors):
    return vectors.select("vec_id", F.size(scalars.vector_or_empty(F.col("embedding"))).cast("long").alias("size"))


@query("benchmark")
def byte_embeddings(items):
    v = scalars.byte_vector(F.col("text"))
    return items.select("item_id", v.alias("v")).select("item_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.array_max("v"), 6).alias("largest"))


@query("documents")
def detected_language(docs):
    return docs.select("doc_id", scalars.language_of(F.col("text")).alias("language"))


# Sources


@query("pages", "SELECT url, NOT (contains(url, 'private') OR page_id % 5 = 0) AS allowed FROM (SELECT concat('https://h', CAST(page_id % 5 AS VARCHAR), '.example/', CASE WHEN page_id % 3 = 0 AND page_id % 5 <> 1 THEN 'private/' WHEN page_id % 5 = 1 THEN 'open/' ELSE 'p/' END, CAST(page_id AS VARCHAR)) AS url, page_id FROM pages) x")
def robots_gate(pages):
    host = F.concat(F.lit("https://h"), (F.col("page_id") % 5).cast("string"), F.lit(".example"))
    part = F.when((F.col("page_id") % 3 == 0) & (F.col("page_id") % 5 != 1), "/private/").when(F.col("page_id") % 5 == 1, "/open/").otherwise("/p/")
    urls = pages.select(F.concat(host, part, F.col("page_id").cast("string")).alias("url"))
    n = F.col("id")
    robots = pages.sparkSession.range(4).select(F.concat(F.lit("https://h"), n.cast("string"), F.lit(".example")).alias("origin"), F.when(n == 1, 404).otherwise(200).alias("status"), F.when(n == 0, "User-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow: /private/").alias("body"))
    more = pages.sparkSession.range(1).select(F.lit("https://h4.example").alias("origin"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /private/").alias("body"))
    return crawl.robots_allowed(urls, robots.unionByName(more), "strandline")


@query("pages", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, '/b') ELSE url END AS final_url, page_id % 3 = 0 AS redirected, page_id % 2 = 0 AS is_html FROM pages")
def retrieval_result(pages):
    chain = F.when(F.col("page_id") % 3 == 0, F.array("url", F.concat("url", F.lit("/b")))).otherwise(F.array("url"))
    kind = F.when(F.col("page_id") % 2 == 0, "text/HTML; charset=utf-8").otherwise(F.lit("application/pdf"))
    return crawl.retrieved(pages.select("page_id", "url", chain.alias("chain"), kind.alias("content_type"))).select("page_id", "final_url", F.col("redirect_chain").isNotNull().alias("redirected"), "is_html")


@query("supplier", "SELECT concat('https://site.example/', CAST(s_suppkey AS VARCHAR)) AS url FROM supplier WHERE s_suppkey % 10 <> 0 ORDER BY url LIMIT 50")
def sitemap_scan(supplier):
    """An index of ten maps, one of which names the index again; a map's entry may be malformed."""
    spark = supplier.sparkSession
    root = spark.range(1).select(F.lit("https://site.example/index.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), *[F.lit(f"<sitemap><loc>https://site.example/map{k}.xml</loc></sitemap>") for k in range(1, 10)], F.lit("</sitemapindex>")).alias("xml"))
    locs = F.concat(F.lit("<url><loc>https://site.example/"), F.col("s_suppkey").cast("string"), F.lit("</loc></url>"))
    maps = supplier.filter("s_suppkey % 10 <> 0").groupBy((F.col("s_suppkey") % 10).alias("k")).agg(F.array_join(F.collect_list(locs), "").alias("body"))
    return tables.sitemap_urls(root.unionByName(maps.select(F.concat(F.lit("https://site.example/map"), F.col("k").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))), cap=50)


@query("part", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE NULL END END AS wait FROM part")
def retry_waits(part):
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, 404).when(k % 2 == 0, 503)
    return part.select("p_partkey", tables.retry_plan(status, k % 3 + 1).alias("wait"))


@query("orders", "WITH x AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey = 3001 THEN 402 WHEN o_orderkey % 5 = 0 THEN 404 WHEN o_orderkey % 7 = 0 THEN 500 ELSE 200 END AS status FROM orders) SELECT row, CASE WHEN row > (SELECT min(row) FROM x WHERE status = 402) THEN 'not_tried' WHEN status = 200 THEN 'matched' WHEN status = 404 THEN 'no_match' WHEN status = 402 THEN 'out_of_credits' ELSE 'error' END AS outcome FROM x")
def enrichment_classes(orders):
    k = F.col("o_orderkey")
    return tables.classified(orders.select(k.alias("row"), F.when(k == 3001, 402).when(k % 5 == 0, 404).when(k % 7 == 0, 500).otherwise(200).alias("status"))).select("row", "outcome")


@query("customer", "SELECT c_custkey, concat('https://example.com/in/', CASE WHEN c_custkey % 2 = 0 THEN 'ann-oak-' ELSE 'bo-elm-' END, CAST(c_custkey AS VARCHAR)) AS candidate_url FROM customer")
def seed_candidates(customer):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, " Ann  Oak ").otherwise("Bo Elm. "), F.col("c_custkey").cast("string"))
    return tables.candidate_urls(customer.select("c_custkey", name.alias("full_name"))).select("c_custkey", "candidate_url")


@query("customer", "SELECT c_custkey, concat('data-', CASE c_custkey % 3 WHEN 0 THEN 'a' ELSE 'b' END, '-', left(sha256(CAST(c_custkey AS VARCHAR)), 8), '.csv') AS name FROM customer WHERE c_custkey % 3 <> 2 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 3 = 2")
def upload_names(customer):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "data  a.CSV").when(k % 3 == 1, "data/b.csv").otherwise("run.exe")
    return customer.select("c_custkey", tables.upload_name(name, k.cast("string")).alias("name"))


@query("customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'company,first_name,last_name,min_likelihood' ELSE 'first_name,last_name,min_likelihood' END AS keys FROM customer")
def person_query_keys(customer):
    rows = customer.select("c_custkey", F.lit("Ann").alias("first_name"), F.lit("Oak").alias("last_name"), F.lit(" ").alias("school"), F.when(F.col("c_custkey") % 2 == 0, "Works").alias("company"), F.lit(None).cast("string").alias("location"))
    return rows.select("c_custkey", F.array_join(F.array_sort(F.map_keys(tables.person_query(rows, 6))), ",").alias("keys"))


@query("customer", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'school.example.edu' WHEN 1 THEN 'https://school.example.edu/sitemap.xml' WHEN 2 THEN 'https://school.example.edu/a/b' ELSE 'file-7.csv' END AS identifier FROM customer")
def source_identifiers(customer):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, " WWW.School.example.edu/ ").when(k == 1, "https://www.school.example.edu/sitemap.xml?x=1").when(k == 2, "school.example.edu/a/b").otherwise("file-7.csv")
    return customer.select("c_custkey", scalars.identifier(F.when(k == 3, "file").otherwise("domain"), raw, F.when(k == 2, 1)).alias("identifier"))


@query("customer", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'North School Example' WHEN 1 THEN 'a plain name' WHEN 2 THEN 'a name of more than thirty-four...' ELSE '' END AS label FROM customer")
def source_labels(customer):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "https://www.north-school_example.edu/x").when(k == 1, " a plain name").when(k == 2, "a name of more than thirty-four characters").otherwise(" ")
    return customer.select("c_custkey", scalars.source_label(raw).alias("label"))


@query("customer", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Ann Oak is clerk at Works. Ann Oak is based in Kiel. Ann Oak earned a BA from North in 1999. Ann Oak was baker at Mill from 2001 to present.' WHEN 1 THEN 'Bo Elm works at Mill. Bo Elm studied at South.' ELSE '' END AS text FROM customer")
def vendor_person_sentences(customer):
    k = F.col("c_custkey") % 3
    full = '{"data":{"full_name":"ann OAK","job_title":" clerk ","job_company_name":"Works","location_locality":"Kiel","education":[{"school":{"name":"North"},"degrees":["BA"],"end_date":"1999-06"},{"school":null}],"experience":[{"company":{"name":"Mill"},"title":{"name":"baker"},"start_date":"2001"}]}}'
    part = '{"first_name":"bo","last_name":"elm","job_company_name":"Mill","education":[{"school":{"name":"South"}}]}'
    rows = customer.select("c_custkey").repartition("c_custkey")  # one file may hold all customers, and each is much work
    return rows.select("c_custkey", tables.person_text(F.when(k == 0, full).when(k == 1, part).otherwise('{"x":1}')).alias("text"))


@query("customer", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1704067200 WHEN 1 THEN 1704070800 END AS taken FROM customer")
def snapshot_times(customer):
    k = F.col("c_custkey") % 3
    return customer.select("c_custkey", scalars.snapshot_time(F.when(k == 0, "2024-01-01T00:00:00Z").when(k == 1, "2024-01-01T02:00:00+01:00").otherwise("soon")).alias("taken"))


@query("runs", "SELECT run_id, round(CASE run_id % 3 WHEN 0 THEN items * 0.1 + 2.0 ELSE items * 0.75 + 22.5 END / 1000000, 6) AS cost FROM runs")
def model_costs(rows):
    model = F.when(F.col("run_id") % 3 == 0, "small").when(F.col("run_id") % 3 == 1, "unknown").otherwise("main")
    return rows.select("run_id", scalars.model_cost(model, F.col("items"), F.lit(5), {"main": (0.75, 4.5), "small": (0.1, 0.4)}, "main").alias("cost"))


@query("runs", "SELECT run_id, concat('{\"n\":\"', CAST(run_id % 5 AS VARCHAR), '\"}') AS payload FROM runs")
def payload_without_key(rows):
    m = F.create_map(F.lit("n"), (F.col("run_id") % 5).cast("string"), F.lit("signature"), F.lit("x"))
    return rows.select("run_id", F.to_json(F.map_filter(m, lambda k, _: k != "signature")).alias("payload"))


@query("customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1999 END AS year FROM customer")
def leading_years(customer):
    return customer.select("c_custkey", scalars.leading_year(F.when(F.col("c_custkey") % 2 == 0, "1999-05").otherwise("May 1999")).alias("year"))


@query("entities aliases claims evidence", f"WITH {_ONE}, ends AS (SELECT claim_id, subject_id AS entity_id FROM claims UNION ALL SELECT claim_id, object_id FROM claims WHERE object_id IS NOT NULL) SELECT b.entity_id, b.label, b.score, count(DISTINCT e.claim_id) AS claims, count(DISTINCT v.raw_id) AS raws FROM best b LEFT JOIN ends e ON e.entity_id = b.entity_id LEFT JOIN evidence v ON v.claim_id = e.claim_id GROUP BY b.entity_id, b.label, b.score")
def trigram_report(entities, aliases, rows, evidence):
    """Entities that resemble a name, with how many claims and distinct raw claims stand behind each."""
    found = graph.trigram_matches(entities, aliases, "the red widgets")
    ends = rows.select("claim_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).join(found.select("entity_id"), "entity_id", "left_semi")
    backing = ends.join(evidence.select("claim_id", "raw_id"), "claim_id", "left").groupBy("entity_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("raw_id").alias("raws"))
    return found.join(backing, "entity_id", "left").select("entity_id", "label", "score", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("raws", F.lit(0)).alias("raws"))


@query("documents", "SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'founded' WHEN doc_id % 3 = 1 THEN 'employed_by' END AS predicate FROM documents WHERE doc_id % 3 <> 2")
def parsed_responses(docs):
    """Answers of an extractor in JSON; malformed ones hold no claims."""
    content = F.when(F.col("doc_id") % 3 == 0, '{"claims":[{"predicate":"founded"}]}').when(F.col("doc_id") % 3 == 1, '{"claims":[{"predicate":"employed_by","x":1}]}').otherwise('{"claims":[{"pred')
    parsed = F.from_json(content, "claims array<struct<predicate:string>>", {"mode": "PERMISSIVE"})["claims"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.filter(F.coalesce(parsed, F.array().cast("array<struct<predicate:string>>")), lambda c: c["predicate"].isNotNull())).alias("c")).select("doc_id", "c.predicate")


@query("sources fetches links fetch_runs runs", f"WITH c AS (SELECT count(DISTINCT url) AS n FROM fetches WHERE source_id = 'src2' AND {OK_2XX} AND (body IS NOT NULL OR body_unchanged_since IS NOT NULL)), w AS (SELECT least(count(*), 10000) AS n FROM ({PENDING}) p WHERE source_id = 'src2'), a AS (SELECT run_id FROM runs WHERE source_id = 'src2' AND status IN ('queued', 'running') ORDER BY started_at DESC, run_id DESC LIMIT 1) SELECT s.source_id, s.identifier, c.n AS pages_fetched, w.n AS pending, (SELECT run_id FROM a) AS active_run FROM sources s CROSS JOIN c CROSS JOIN w WHERE s.source_id = 'src2'")
def source_detail(sources, fetches, links, fetch_runs, rows):
    """One source with its counts and newest active run; every table is filtered to it before anything is joined."""
    one = tables.lookup(sources, "source_id", "src2").select("source_id", "identifier")
    own = fetches.filter("source_id = 'src2'")
    out = one.join(coverage.pages_fetched(own), "source_id", "left").join(coverage.pending_counts(own, links), "source_id", "left")
    active = runs.newest_active(rows.filter("source_id = 'src2'")).select("source_id", F.col("run_id").alias("active_run"))
    return out.join(active, "source_id", "left").select("source_id", "identifier", F.coalesce("pages_fetched", F.lit(0)).alias("pages_fetched"), F.coalesce("pending", F.lit(0)).alias("pending"), "active_run")


_MADE = {"founded": ("Ida Lindqvist launched Tide Works last year.", "Tide Works"), "studied_at": ("Ida Lindqvist graduated from Harbor College in spring.", "Harbor College"), "partnered_with": ("Ida Lindqvist partnered with Bo Strand on it.", "Bo Strand"), "employed_by": ("Ida Lindqvist joined Tide Works, then left.", "Tide Works"), "worked_on_project": ("Ida Lindqvist developed Night Ferry for years.", "Night Ferry")}


@query("supplier", "SELECT s_suppkey AS doc_id, 'Ida Lindqvist' AS subject, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_MADE)) + " END AS predicate, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{v[1]}'" for i, v in enumerate(_MADE.values())) + " END AS object FROM supplier WHERE s_suppkey % 6 < 5")
def pattern_claims_made(supplier):
    """One sentence a supplier, a relation each by remainder; the sixth holds a headline's company and no claim."""
    from ..operators import extraction

    k, text = F.col("s_suppkey") % 6, F.lit("Market Rally LLC said nothing of it.")
    for i, (sentence, _) in enumerate(_MADE.values()):
        text = F.when(k == i, sentence).otherwise(text)
    return extraction.extract(supplier.select(F.col("s_suppkey").cast("long").alias("doc_id"), text.alias("text"))).select("doc_id", "subject", "predicate", "object")
