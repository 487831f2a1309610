"""Further claim-graph queries: look-ups, sinks, updates, endpoint compositions and small scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import claims, coverage, curation, graph, names, review, runs
from ..sources import tables
from .bridge import BASE, NOW
from .queries import OK_2XX, ORACLES, PENDING, QUERIES, query

QUERIES["catalog_counts"] = lambda spark, sf_dir: tables.table_counts(spark, sf_dir, (*BASE, "claims_missing"))
ORACLES["catalog_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in BASE) + " UNION ALL SELECT 'claims_missing', 0"


@query("fetches", "SELECT fetch_id, url, http_status FROM fetches WHERE fetch_id = 42")
def point_lookup(fetches):
    return tables.lookup(fetches, "fetch_id", 42).select("fetch_id", "url", "http_status")


@query("entities claims", "SELECT entity_id, name FROM entities WHERE entity_id IN (SELECT subject_id FROM claims WHERE claim_id % 1000 = 1)")
def batched_lookup(entities, rows):
    return tables.lookup_many(entities, rows.filter("claim_id % 1000 = 1").select(F.col("subject_id").alias("entity_id")), "entity_id").select("entity_id", "name")


@query("fetches", "SELECT fetch_id, CASE WHEN http_status = 503 THEN CASE WHEN body IS NOT NULL THEN 200 END ELSE http_status END AS http_status, sha256(body) AS content_hash, octet_length(encode(body)) AS bytes_size FROM fetches")
def fetch_sink(fetches):
    answers = fetches.withColumn("http_status", F.nullif("http_status", F.lit(503))).withColumn("error", F.lit(None).cast("string"))
    return tables.fetch_rows(answers).select("fetch_id", "http_status", "content_hash", F.col("bytes_size").cast("long").alias("bytes_size"))


@query("links", "SELECT document_id, fetch_id FROM links UNION SELECT document_id, fetch_id + 1 FROM links WHERE fetch_id % 5 = 0")
def link_insert(links):
    return tables.append_missing(links.distinct(), links.filter("fetch_id % 5 = 0").withColumn("fetch_id", F.col("fetch_id") + 1), ["document_id", "fetch_id"])


@query("documents claims entities evidence", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM evidence) AS evidence, false AS empty")
def startup_counts(documents, rows, entities, evidence):
    out = None
    for name, df in (("documents", documents), ("claims", rows), ("entities", entities), ("evidence", evidence)):
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)  # single rows
    return out.withColumn("empty", F.col("documents") + F.col("claims") + F.col("entities") + F.col("evidence") == 0)


@query("runs", "SELECT run_id, stats_updated_at, started_at FROM runs WHERE source_id = 'src3' ORDER BY stats_updated_at DESC NULLS LAST, started_at DESC, run_id LIMIT 100")
def nulls_last_order(rows):
    return rows.filter("source_id = 'src3'").orderBy(F.desc_nulls_last("stats_updated_at"), F.desc("started_at"), "run_id").limit(100).select("run_id", "stats_updated_at", "started_at")


@query("sources", "SELECT source_id, last_full_recrawl_at FROM sources WHERE status <> 'archived' ORDER BY last_full_recrawl_at ASC NULLS LAST, identifier")
def source_order(sources):
    return sources.filter("status <> 'archived'").orderBy(F.asc_nulls_last("last_full_recrawl_at"), "identifier").select("source_id", "last_full_recrawl_at")


@query("fetches", "SELECT count(*) FILTER (WHERE source_id <> 'src1') AS foreign_ids, count(*) FILTER (WHERE source_id <> 'src1') = 0 AS owned FROM fetches WHERE fetch_id IN (1, 21, 41, 61, 82)")
def ownership_check(fetches):
    given = fetches.filter(F.col("fetch_id").isin(1, 21, 41, 61, 82))
    return given.agg(F.count_if(F.col("source_id") != "src1").alias("foreign_ids")).withColumn("owned", F.col("foreign_ids") == 0)


@query("raws evidence", "SELECT r.raw_id, coalesce(CASE WHEN r.raw_id % 2 = 0 THEN r.document_id END, e.d) AS document_id FROM raws r LEFT JOIN (SELECT raw_id, min(document_id) AS d FROM evidence GROUP BY raw_id) e ON e.raw_id = r.raw_id")
def backfill_document_ids(raws, evidence):
    known = evidence.groupBy("raw_id").agg(F.min("document_id").alias("d"))
    return raws.join(known, "raw_id", "left").select("raw_id", F.coalesce(F.when(F.col("raw_id") % 2 == 0, F.col("document_id")), "d").alias("document_id"))


@query("sources", f"SELECT source_id, greatest(1, CASE WHEN source_id = 'src2' THEN 0 ELSE recrawl_interval_days END) AS recrawl_interval_days, nullif(trim(CASE WHEN source_id = 'src1' THEN '  ' ELSE identifier END), '') AS notes, CASE WHEN source_id = 'src4' THEN {NOW} ELSE last_full_recrawl_at END AS last_full_recrawl_at FROM sources")
def source_partial_update(sources):
    patch = F.when(F.col("source_id") == "src2", 0)
    notes = F.when(F.col("source_id") == "src1", "  ").otherwise(F.col("identifier"))
    stamp = F.when(F.col("source_id") == "src4", F.lit(NOW).cast("long"))
    return sources.select("source_id", F.greatest(F.lit(1), F.coalesce(patch, "recrawl_interval_days")).alias("recrawl_interval_days"), F.nullif(F.trim(notes), F.lit("")).alias("notes"), F.coalesce(stamp, "last_full_recrawl_at").alias("last_full_recrawl_at"))


@query("runs", f"SELECT run_id, CASE WHEN status IN ('queued', 'running') THEN 'stopped' ELSE status END AS status, coalesce(stats_updated_at, CASE WHEN status IN ('queued', 'running') THEN {NOW} END) AS finished_at FROM runs WHERE source_id = 'src6'")
def stop_runs(rows):
    live = F.col("status").isin("queued", "running")
    return rows.filter("source_id = 'src6'").select("run_id", F.when(live, "stopped").otherwise(F.col("status")).alias("status"), F.coalesce("stats_updated_at", F.when(live, F.lit(NOW).cast("long"))).alias("finished_at"))


@query("runs", "SELECT run_id, round((items * 0.75 + run_id % 1000 * 4.5) / 1000000, 6) AS cost FROM runs")
def run_cost(rows):
    return rows.select("run_id", scalars.cost(F.lit(0.75), F.lit(4.5), F.col("items"), F.col("run_id") % 1000).alias("cost"))


@query("runs", "SELECT run_id, round(greatest(0.0, least(100.0, (run_id % 137) / 90 * 100)), 1) AS percent FROM runs")
def progress_percent(rows):
    return rows.select("run_id", runs.percent(F.col("run_id") % 137, F.lit(90)).alias("percent"))


@query("sources runs fetches links", f"""WITH cover AS (SELECT source_id, count(DISTINCT url) AS n FROM fetches WHERE {OK_2XX} AND (body IS NOT NULL OR body_unchanged_since IS NOT NULL) GROUP BY source_id),
w AS (SELECT source_id, count(*) AS n FROM ({PENDING}) x GROUP BY source_id),
act AS (SELECT DISTINCT source_id FROM runs WHERE status IN ('queued', 'running') AND kind = 'parse'),
last AS (SELECT source_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs) r WHERE n = 1)
SELECT s.source_id, s.identifier, coalesce(cover.n, 0) AS pages_fetched, CASE WHEN act.source_id IS NOT NULL THEN 0 ELSE coalesce(w.n, 0) END AS pending, last.run_id AS last_run FROM sources s LEFT JOIN cover ON cover.source_id = s.source_id LEFT JOIN w ON w.source_id = s.source_id LEFT JOIN act ON act.source_id = s.source_id LEFT JOIN last ON last.source_id = s.source_id WHERE s.status <> 'archived'""")
def source_list(sources, rows, fetches, links):
    """The endpoint's row: coverage, the newest run, and nothing pending while a parse is under way."""
    busy = rows.filter(F.col("status").isin("queued", "running") & (F.col("kind") == "parse")).select("source_id").distinct().withColumn("busy", F.lit(True))
    newest = rows.groupBy("source_id").agg(F.max(F.struct("started_at", "run_id")).alias("r")).select("source_id", F.col("r.run_id").alias("last_run"))
    out = sources.filter("status <> 'archived'").join(coverage.pages_fetched(fetches), "source_id", "left").join(coverage.pending_counts(fetches, links), "source_id", "left").join(busy, "source_id", "left").join(newest, "source_id", "left")
    return out.select("source_id", "identifier", F.coalesce("pages_fetched", F.lit(0)).alias("pages_fetched"), F.when(F.col("busy"), 0).otherwise(F.coalesce("pending", F.lit(0))).alias("pending"), "last_run")


@query("claims entities conflicts", "SELECT 's5' AS entity_id, (SELECT name FROM entities WHERE entity_id = 's5') AS name, (SELECT count(*) FROM claims WHERE subject_id = 's5' OR object_id = 's5') AS claims, (SELECT count(*) FROM conflicts WHERE claim_a IN (SELECT claim_id FROM claims WHERE subject_id = 's5' OR object_id = 's5') OR claim_b IN (SELECT claim_id FROM claims WHERE subject_id = 's5' OR object_id = 's5')) AS conflicts")
def entity_detail(rows, entities, conflicts):
    own = claims.touching(rows, "s5").select("claim_id")
    hit = coverage.conflict_ends(conflicts).join(own, "claim_id", "left_semi").agg(F.countDistinct("conflict_id").alias("conflicts"))
    one = entities.filter("entity_id = 's5'").select("entity_id", "name")
    return one.join(own.agg(F.count("*").alias("claims"))).join(hit)  # single rows


@query("links fetches document_rows", "SELECT document_id, fetch_id, url, n AS fetches FROM (SELECT l.document_id, f.fetch_id, f.url, count(*) OVER (PARTITION BY l.document_id) AS n, row_number() OVER (PARTITION BY l.document_id ORDER BY f.fetched_at DESC, f.fetch_id DESC) AS r FROM links l JOIN fetches f ON f.fetch_id = l.fetch_id JOIN document_rows d ON d.document_id = l.document_id WHERE f.source_id = 'src1') x WHERE r = 1 ORDER BY document_id LIMIT 20")
def documents_of_source(links, fetches, documents):
    """Documents of one source, once each before paging, with their newest fetch."""
    rows = links.join(fetches.filter("source_id = 'src1'").select("fetch_id", "url", "fetched_at"), "fetch_id").join(documents.select("document_id"), "document_id", "left_semi")
    once = rows.groupBy("document_id").agg(F.max(F.struct("fetched_at", "fetch_id", "url")).alias("f"), F.count("*").alias("fetches"))
    return claims.page(once.select("document_id", "f.fetch_id", "f.url", "fetches"), 1, 20, 100, F.col("document_id"))


@query("claims evidence entities", "SELECT c.claim_id, o.name AS object_name, e.source_id FROM claims c LEFT JOIN entities o ON o.entity_id = c.object_id LEFT JOIN evidence e ON e.claim_id = c.claim_id WHERE c.subject_id = 's9' ORDER BY c.claim_id, e.source_id, e.raw_id, o.name LIMIT 5")
def top_claims_of_entity(rows, evidence, entities):
    target = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"))
    out = rows.filter("subject_id = 's9'").join(target, "object_id", "left").join(evidence.select("claim_id", "source_id", F.col("raw_id").alias("evidence_raw")), "claim_id", "left")
    return out.orderBy("claim_id", F.asc_nulls_last("source_id"), F.asc_nulls_last("evidence_raw"), F.asc_nulls_last("object_name")).limit(5).select("claim_id", "object_name", "source_id")


@query("claims entities evidence quotes document_rows sources", "WITH e2 AS (SELECT claim_id, first_seen_at, object_id, subject_id AS entity_id FROM claims UNION ALL SELECT claim_id, first_seen_at, object_id, object_id FROM claims WHERE object_id IS NOT NULL AND object_id <> subject_id), x AS (SELECT e2.entity_id, e2.claim_id, o.name AS object_name, e.raw_id, d.document_id, s.identifier AS source_name, row_number() OVER (PARTITION BY e2.entity_id ORDER BY e2.first_seen_at DESC, e2.claim_id, e.raw_id NULLS LAST, e.source_id NULLS LAST) AS place FROM e2 LEFT JOIN entities o ON o.entity_id = e2.object_id LEFT JOIN evidence e ON e.claim_id = e2.claim_id LEFT JOIN quotes q ON q.raw_id = e.raw_id LEFT JOIN document_rows d ON d.document_id = q.document_id LEFT JOIN sources s ON s.source_id = e.source_id) SELECT entity_id, CAST(place AS INT) AS place, claim_id, object_name, raw_id, document_id, source_name FROM x WHERE place <= 5")
def top_claims(rows, entities, evidence, raws, documents, sources):
    """The five first rows of every entity's claims through the whole chain."""
    return review.top_claims(rows, entities, evidence, raws, documents, sources)


@query("claims evidence entities", "SELECT c.entity_id, c.neighbor_id, n.name AS neighbor_name, n.kind AS neighbor_kind, count(DISTINCT e.raw_id) AS evidence_count FROM (SELECT claim_id, subject_id AS entity_id, object_id AS neighbor_id FROM claims WHERE object_id IS NOT NULL UNION ALL SELECT claim_id, object_id, subject_id FROM claims WHERE object_id IS NOT NULL) c JOIN entities n ON n.entity_id = c.neighbor_id LEFT JOIN evidence e ON e.claim_id = c.claim_id GROUP BY c.entity_id, c.neighbor_id, n.name, n.kind")
def named_neighborhood(rows, evidence, entities):
    """Every entity's neighbours by name and kind."""
    named = entities.select(F.col("entity_id").alias("neighbor_id"), F.col("name").alias("neighbor_name"), F.col("kind").alias("neighbor_kind"))
    return graph.neighborhood(rows, evidence).join(named, "neighbor_id").select("entity_id", "neighbor_id", "neighbor_name", "neighbor_kind", "evidence_count")


@query("claims evidence raws", "SELECT e.source_id, count(*) AS rows, count(DISTINCT e.claim_id) AS claims FROM evidence e JOIN raws r ON r.raw_id = e.raw_id AND r.source_id = e.source_id WHERE e.claim_id IN (SELECT claim_id FROM claims) GROUP BY e.source_id")
def provenance_same_source(rows, evidence, raws):
    """Evidence whose raw claim comes from the very source it is filed under: both equalities in one join."""
    own = evidence.join(raws.select("raw_id", "source_id"), ["raw_id", "source_id"]).join(rows.select("claim_id"), "claim_id", "left_semi")
    return own.groupBy("source_id").agg(F.count("*").alias("rows"), F.countDistinct("claim_id").alias("claims"))


@query("entities aliases", "SELECT entity_id, alias FROM aliases UNION ALL SELECT e.entity_id, concat('the ', lower(name)) FROM entities e WHERE e.kind = 'project' AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.entity_id AND lower(a.alias) = concat('the ', lower(e.name)))")
def add_aliases(entities, aliases):
    new = entities.filter("kind = 'project'").select("entity_id", F.concat(F.lit("the "), F.lower("name")).alias("alias"))
    have = aliases.select("entity_id", F.lower("alias").alias("alias"))
    return aliases.unionByName(new.join(have, ["entity_id", "alias"], "left_anti"))


@query("labels", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'dispute' WHEN quality = 1 THEN 'verify' ELSE 'split' END AS decision FROM labels")
def review_decisions(labels):
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "dispute").when(F.col("quality") == 1, "verify").otherwise("split").alias("decision"))


@query("fetches", f"SELECT source_id, n FROM (SELECT source_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source_id, count(*) AS n FROM fetches WHERE NOT {OK_2XX} GROUP BY source_id UNION ALL SELECT source_id, count(*) FROM fetches WHERE parse_skip_reason IS NOT NULL GROUP BY source_id) u GROUP BY source_id) t")
def summary_merge(fetches):
    bad = fetches.filter(~coverage.succeeded()).groupBy("source_id").agg(F.count("*").alias("n"))
    skipped = fetches.filter("parse_skip_reason is not null").groupBy("source_id").agg(F.count("*").alias("n"))
    return curation.summed([bad, skipped], "source_id")


@query("runs", "SELECT client, first FROM (SELECT DISTINCT source_id AS client, trim(string_split(concat(source_id, ' , 10.0.0.1'), ',')[1]) AS first FROM runs) x")
def forwarded_for(rows):
    return rows.select(F.col("source_id").alias("client"), F.trim(F.split(F.concat("source_id", F.lit(" , 10.0.0.1")), ",")[0]).alias("first")).distinct()


@query("claims", "SELECT predicate, count(*) AS claims, count(DISTINCT subject_id) FILTER (WHERE valid_to IS NULL) AS open_subjects, max(first_seen_at) AS newest FROM claims GROUP BY predicate")
def predicate_profile(rows):
    return rows.groupBy("predicate").agg(F.count("*").alias("claims"), F.countDistinct(F.when(F.col("valid_to").isNull(), F.col("subject_id"))).alias("open_subjects"), F.max("first_seen_at").alias("newest"))


@query("claims", "SELECT subject_id, object_id, count(*) AS claims FROM claims c WHERE object_id IN (SELECT object_id FROM claims WHERE subject_id = 's2' AND object_id IS NOT NULL) GROUP BY subject_id, object_id")
def shared_objects(rows):
    near = rows.filter("subject_id = 's2' and object_id is not null").select("object_id").distinct()
    return rows.join(near, "object_id", "left_semi").groupBy("subject_id", "object_id").agg(F.count("*").alias("claims"))


@query("customer", "SELECT c_custkey, concat('Customer ', c_custkey, ' is clerk at ', upper(c_mktsegment), '. Customer ', c_custkey, ' is based in Nation ', c_nationkey, '. Customer ', c_custkey, ' studied at School ', c_custkey % 9, '.', CASE WHEN c_custkey % 2 = 0 THEN concat(' Customer ', c_custkey, ' was baker at Mill.') ELSE concat(' Customer ', c_custkey, ' worked at Mill from 2003 to 2007.') END) AS text FROM customer")
def vendor_person_text(customer):
    school = F.array(F.struct(F.struct(F.concat(F.lit("School "), F.col("c_custkey") % 9).alias("name")).alias("school")))
    even = F.col("c_custkey") % 2 == 0
    post = F.array(F.struct(F.struct(F.lit("Mill").alias("name")).alias("company"), F.when(even, F.struct(F.lit("baker").alias("name"))).alias("title"), F.when(~even, "2003-04").alias("start_date"), F.when(~even, "2007").alias("end_date")))
    json = F.to_json(F.struct(F.concat(F.lit("customer "), "c_custkey").alias("full_name"), F.lit("clerk").alias("job_title"), F.col("c_mktsegment").alias("job_company_name"), F.concat(F.lit("Nation "), "c_nationkey").alias("location_name"), school.alias("education"), post.alias("experience")))
    rows = customer.select("c_custkey", "c_mktsegment", "c_nationkey").repartition("c_custkey")  # one file may hold all customers, and each is much work
    return rows.select("c_custkey", tables.person_text(json).alias("text"))


@query("entities")
def graph_star_labels(entities):
    return entities.select("entity_id", scalars.title_case(F.col("name")).alias("label"), F.size(graph.trigrams(F.col("name"))).alias("trigrams"))


@query("conversations", "SELECT conv_id, string_agg(concat(role, ': ', text), ' | ' ORDER BY turn, role, text) AS context FROM conversations GROUP BY conv_id")
def answer_context(turns):
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return parts.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), " | ").alias("context"))


@query("runs", "SELECT run_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs WHERE kind <> 'parse' AND status = 'complete') x WHERE n <= 50")
def runs_of_source(rows):
    w = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return rows.filter("kind <> 'parse' and status = 'complete'").withColumn("n", F.row_number().over(w)).filter("n <= 50").select("run_id", "source_id")




# Names of the given tables

_QUOTED = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
_WORDS = "list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> '')"
_PLAIN = f"(trim({{0}}) <> '' AND length(trim({{0}})) <= 80 AND NOT regexp_matches(trim({{0}}), '[\\n\\t]|\\.\\s+[A-Z]|[,;:!?]$') AND len(list_filter({_WORDS}, lambda w: lower(w) IN ({_QUOTED(names.PRONOUNS)}))) = 0)"
_PERSON = f"(len({_WORDS}) BETWEEN 2 AND 5 AND len(list_filter({_WORDS}, lambda w: NOT (regexp_matches(w, '^\\p{{{{Lu}}}}') AND lower(w) NOT IN ({_QUOTED(names.NEWS)}) AND length(regexp_replace(w, '[^\\p{{{{L}}}}]', '', 'g')) >= greatest(2, length(w) - 1)))) = 0 AND len(list_filter([{_QUOTED(names.COMPANIES)}], lambda c: ends_with(trim({{0}}), c))) = 0)"
_OTHER = f"(len(list_filter({_WORDS}, lambda w: NOT regexp_matches(w, '^[\\p{{{{L}}}}\\p{{{{N}}}}]'))) = 0)"
VALID = "({plain} AND CASE WHEN {{1}} = 'person' THEN {person} WHEN {{1}} IN ('org', 'place', 'project', 'event') THEN {other} ELSE true END)".format(plain=_PLAIN, person=_PERSON, other=_OTHER).replace("{{1}}", "{1}")


@query("entities aliases customer nation", f"WITH n AS (SELECT entity_id AS id, kind, name FROM entities UNION ALL SELECT entity_id, 'org', alias FROM aliases UNION ALL SELECT concat('n', CAST(c_custkey AS VARCHAR)), 'person', concat('Meet ', upper(n_name[1]), lower(n_name[2:]), ' ', upper(c_mktsegment[1]), lower(c_mktsegment[2:])) FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT id, kind, name, {VALID.format('name', 'kind')} AS valid FROM n")
def entity_name_check(entities, aliases, customer, nation):
    """Names of all entities, aliases as organisations, and customers by nation and segment, against the structural check."""
    both = entities.select(F.col("entity_id").alias("id"), "kind", "name").unionByName(aliases.select(F.col("entity_id").alias("id"), F.lit("org").alias("kind"), F.col("alias").alias("name")))
    shaped = lambda c: F.concat(F.upper(F.left(F.col(c), F.lit(1))), F.lower(F.substring(F.col(c), F.lit(2), F.length(c))))
    people = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("id"), F.lit("person").alias("kind"), F.concat(F.lit("Meet "), shaped("n_name"), F.lit(" "), shaped("c_mktsegment")).alias("name"))
    rows = both.unionByName(people)
    return rows.select("id", "kind", "name", names.valid_name(F.col("name"), F.col("kind")).alias("valid"))


@query("entities mentions claims", f"WITH used AS (SELECT entity_id FROM mentions UNION SELECT subject_id FROM claims UNION SELECT object_id FROM claims WHERE object_id IS NOT NULL) SELECT e.entity_id, e.name, CASE WHEN e.entity_id IN (SELECT entity_id FROM used) THEN 'flag' ELSE 'archive' END AS action FROM entities e WHERE e.kind = 'person' AND NOT {VALID.format('e.name', 'e.kind')}")
def invalid_person_entities(entities, mentions, rows):
    """Persons of the entities whose name is no name: flagged if a mention or either end of a claim refers to them."""
    return names.invalid_people(entities, mentions, rows.select(F.col("subject_id").alias("entity_id")), rows.filter("object_id is not null").select(F.col("object_id").alias("entity_id")))


@query("part", "SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(trim(trim(p_name), '.,;:'), '\\s+', ' ', 'g')), ' '), lambda w: CASE WHEN lower(w) IN ('of', 'and', 'for', 'the') THEN lower(w) ELSE concat(upper(w[1]), lower(w[2:])) END), ' ') AS title FROM part")
def part_titles(part):
    return part.select("p_partkey", names.title_form(F.col("p_name")).alias("title"))
