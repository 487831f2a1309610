"""Reading and writing: catalog counts, key lookups, delimited files, sitemaps, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import collapsed, first_filled, header_key
from ..session import checkpointed


def table_counts(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """(table, rows) of each name, 0 where there is no such table: one plan, counts from the files' footers where possible."""
    out = None
    for name in names:
        try:
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        except Exception as e:  # a missing table counts 0; anything else is an error
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.range(1).select(F.lit(name).alias("table"), F.lit(0).cast("long").alias("rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value).limit(1)


def lookup_many(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def read_rows(spark: SparkSession, path: str, normalise_headers: bool = True) -> DataFrame:
    """A delimited file with a header, every value a string, absent ones ''; a byte-order mark does not matter."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if normalise_headers:
        plain = [c.lstrip("﻿") for c in rows.columns]
        keys = spark.range(1).select(*[header_key(F.lit(c)).alias(str(i)) for i, c in enumerate(plain)]).first()
        rows = rows.toDF(*[k or f"column_{i}" for i, k in enumerate(keys)])
    return rows.fillna("")


def candidate_urls(rows: DataFrame, template: str = "https://example.com/in/") -> DataFrame:
    """The URL to fetch for each seed row: a given one, else one made from the name."""
    have = [c for c in ("url", "website", "link", "profile_url") if c in rows.columns]
    given = first_filled(*[F.col(c) for c in have]) if have else F.lit(None).cast("string")
    name = first_filled(*[F.col(c) for c in ("name", "full_name") if c in rows.columns] or [F.lit("")])
    made = F.concat(F.lit(template), F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")))
    return rows.withColumn("candidate_url", F.coalesce(given, made))


def sitemap_urls(maps: DataFrame, cap: int = 10_000) -> DataFrame:
    """URLs of sitemap documents (url, xml), indexes followed by joins until nothing new is named; malformed ones are empty."""
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    named = maps.select("url", F.col("xml").rlike(r"<(?:\w+:)?sitemapindex").alias("index"), F.explode(locs).alias("loc"))
    roots = maps.join(named.filter("index").select(F.col("loc").alias("url")), "url", "left_anti").select("url").distinct()
    reached, seen = checkpointed(roots), roots
    while True:
        reached = checkpointed(reached.join(named.filter("index"), "url").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"))
        if reached.isEmpty():
            break
        seen = checkpointed(seen.union(reached))
    return named.filter(~F.col("index")).join(seen, "url", "left_semi").select(F.col("loc").alias("url")).distinct().orderBy("url").limit(cap)


def fetch_rows(responses: DataFrame) -> DataFrame:
    """Fetches as they are stored: status 200 where a body came without one, digest and size derived."""
    status = F.coalesce("http_status", F.when(F.col("body").isNotNull() & F.col("error").isNull(), F.lit(200)))
    return responses.withColumn("http_status", status).withColumn("content_hash", F.sha2("body", 256)).withColumn("bytes_size", F.octet_length("body"))


def retry_plan(status: Column, attempt: Column) -> Column:
    """Seconds to wait before another attempt, null if there is none: transport errors and 5xx wait 1, then 2."""
    return F.when((status.isNull() | (status >= 500)) & (attempt < 3), F.pow(F.lit(2.0), attempt - 1))


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old plus the rows of new whose key it lacks, one a key: an idempotent insert."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def classified(answers: DataFrame) -> DataFrame:
    """Enrichment answers by class, in row order; rows after the first that ran out of credit are not tried."""
    kind = F.when(F.col("status") == 200, "matched").when(F.col("status") == 404, "no_match").when(F.col("status") == 402, "out_of_credits").otherwise("error")
    end = answers.filter("status = 402").agg(F.min("row").alias("__end"))  # one row
    return answers.join(F.broadcast(end)).withColumn("outcome", F.when(F.col("row") > F.col("__end"), "not_tried").otherwise(kind)).drop("__end")


def person_text(json: Column) -> Column:
    """Sentences of a vendor's person record: job, place, education, the first ten positions; '' for a record without a name."""
    named = "struct<name:string>"
    fields = "full_name string, first_name string, middle_name string, last_name string, job_title string, job_company_name string, location_name string, location_locality string, location_region string, "
    fields += f"education array<struct<school:{named},degrees:array<string>,majors:array<string>,end_date:string>>, experience array<struct<company:{named},title:{named},start_date:string,end_date:string>>"
    own = F.from_json(json, fields)
    inner = F.from_json(json, f"data struct<{', '.join(x.strip().replace(' ', ':', 1) for x in fields.split(', '))}>")["data"]

    def bound(c: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(c), use), F.lit(0))  # an array of one element, so that c is found once, however often it is used

    def filled(c: Column) -> Column:
        return bound(collapsed(c), lambda x: F.nullif(x, F.lit("")))

    def year(c: Column) -> Column:
        return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit(""))

    def sentences(p: Column) -> Column:
        cased = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
        name = cased(F.coalesce(filled(p["full_name"]), filled(F.concat_ws(" ", *[filled(p[c]) for c in ("first_name", "middle_name", "last_name")]))))
        return bound(name, lambda n: about(p, n))

    def about(p: Column, name: Column) -> Column:
        say = lambda *parts: F.concat(name, *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("."))
        title, company = filled(p["job_title"]), filled(p["job_company_name"])
        job = F.coalesce(say(" is ", title, " at ", company), say(" is ", title), say(" works at ", company))
        place = say(" is based in ", F.coalesce(*[filled(p[c]) for c in ("location_name", "location_locality", "location_region")]))

        def studied(e: Column) -> Column:
            school, end = filled(e["school"]["name"]), year(e["end_date"])
            degree = F.coalesce(filled(F.get(e["degrees"], F.lit(0))), filled(F.get(e["majors"], F.lit(0))))
            return F.coalesce(say(" earned a ", degree, " from ", school, " in ", end), say(" earned a ", degree, " from ", school), say(" studied at ", school, " until ", end), say(" studied at ", school))

        def worked(e: Column) -> Column:
            firm, post, start, end = filled(e["company"]["name"]), filled(e["title"]["name"]), year(e["start_date"]), F.coalesce(year(e["end_date"]), F.lit("present"))
            return F.coalesce(say(" was ", post, " at ", firm, " from ", start, " to ", end), say(" was ", post, " at ", firm), say(" worked at ", firm, " from ", start, " to ", end), say(" worked at ", firm))

        none = F.array().cast("array<string>")
        lines = F.concat(F.array(job, place), F.coalesce(F.transform(p["education"], studied), none), F.coalesce(F.transform(F.slice(p["experience"], 1, 10), worked), none))
        return F.when(name.isNull(), "").otherwise(F.array_join(F.filter(lines, lambda x: x.isNotNull()), " "))

    return F.coalesce(bound(F.coalesce(inner, own), sentences), F.lit(""))


def person_query(rows: DataFrame, least: int) -> Column:
    """Parameters of a person look-up as a map, blanks left out."""
    kept = F.create_map(*[x for c in ("first_name", "last_name", "school", "company", "location") for x in (F.lit(c), F.nullif(F.trim(F.col(c)), F.lit("")))])
    return F.map_concat(F.map_filter(kept, lambda _, v: v.isNotNull()), F.create_map(F.lit("min_likelihood"), F.lit(str(least))))


def upload_name(name: Column, content: Column, allowed: tuple[str, ...] = ("csv", "xlsx")) -> Column:
    """The name a file is kept under: a slug, eight digits of its content's hash, its ending; null for other endings."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    stem = F.btrim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(ending.isin(*allowed), F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("source")), F.lit("-"), F.substring(F.sha2(content, 256), 1, 8), F.lit("."), ending))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells): rows of the first sheet of workbooks as maps of header to string; unnamed columns are dropped.

    A workbook is a zip of XML; each is read by one task.
    """
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def place(ref: str) -> int:
        n = 0
        for c in re.match("[A-Z]+", ref)[0]:
            n = n * 26 + ord(c) - 64
        return n

    def rows_of(raw: bytes) -> list[dict[int, str]]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
            sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        out = []
        for row in sheet.iter(f"{space}row"):
            cells = {}
            for c in row.iter(f"{space}c"):
                value, inline = c.find(f"{space}v"), c.find(f"{space}is")
                text = "".join(t.text or "" for t in inline.iter(f"{space}t")) if inline is not None else (value.text or "" if value is not None else "")
                cells[place(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text else text
            out.append(cells)
        return out

    def run(frames):
        import pandas as pd

        for f in frames:
            found = []
            for name, raw in zip(f["path"], f["content"], strict=True):
                head, *rest = rows_of(bytes(raw)) or [{}]
                found += [(name, i, {h.strip(): r.get(k, "") for k, h in head.items() if h.strip()}) for i, r in enumerate(rest)]
            yield pd.DataFrame(found, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells map<string,string>")
