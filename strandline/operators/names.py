"""Names and titles as Column expressions: headline prefixes, the structural name check, claim validation with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary of extracted claims.
PREDICATES = ("current_title", "employed_by", "studied_at", "founded", "partnered_with", "mentored_by", "worked_on_project", "located_in", "affiliated_with", "class_year", "related_to")
ENTITY_TYPES = ("person", "org", "project", "place", "event")
OBJECT_TYPES = ("person", "org", "project", "place", "event", "attribute_value", "date")
#: First words of headlines, words that no name holds, words of headlines, endings of companies.
HEADLINES = ("Meet ", "Introducing ", "About ", "Q&A with ", "A Conversation with ")
PRONOUNS = ("he", "she", "they", "it", "we", "i", "you", "his", "her", "their", "its", "our", "your")
NEWS = (
    "selloff", "sell-off", "rally", "crash", "surge", "plunge", "rebound", "drop", "drops", "halts", "halt", "resumes", "resume", "launches",
    "launch", "announces", "announce", "kicks", "kicked", "opens", "closes", "ends", "begins", "starts", "reveals", "unveils", "tops", "beats",
    "misses", "gains", "loses", "posts", "reports", "breaking", "exclusive", "update",
)
COMPANIES = (
    " LLC", " L.L.C.", " LLC.", " Inc", " Inc.", " Incorporated", " Co.", " Co", " Corp", " Corp.", " Corporation", " Ltd", " Ltd.", " Limited",
    " LLP", " L.L.P.", " LP", " L.P.", " PLLC", " PBC", " GmbH", " AG", " S.A.", " S.A.S.", " S.A.R.L.", " N.V.", " B.V.", " Pty Ltd", " Pty. Ltd.",
)
LONGEST = 80


def without_headline(text: Column) -> Column:
    """text without the first headline prefix that it begins with."""
    trimmed = F.trim(text)
    out = trimmed
    for prefix in reversed(HEADLINES):
        out = F.when(trimmed.startswith(prefix), F.trim(F.substring(trimmed, F.lit(len(prefix) + 1), F.length(trimmed)))).otherwise(out)
    return out


def headline_stripped(text: Column) -> Column:
    """(text, changed): what is left of a name and whether a prefix went."""
    bare = without_headline(text)
    return F.struct(bare.alias("text"), F.coalesce(bare != F.trim(text), F.lit(False)).alias("changed"))


def title_form(text: Column) -> Column:
    """A title with every word capitalised but the small ones."""
    words = F.split(F.trim(F.regexp_replace(F.btrim(F.trim(text), F.lit(".,;:")), r"\s+", " ")), " ")
    shaped = F.transform(words, lambda w: F.when(F.lower(w).isin("of", "and", "for", "the"), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.array_join(shaped, " ")


def organisation_form(text: Column) -> Column:
    """What stands before the first "and", without an article in front and punctuation around."""
    first = F.get(F.split(F.trim(text), r"\s+and\s+(?:the\s+)?", 2), F.lit(0))
    return F.regexp_replace(F.btrim(first, F.lit(".,;:")), r"(?i)^the\s+", "")


def valid_name(text: Column, kind: Column) -> Column:
    """Whether text can be the name of a kind: its length, breaks, pronouns and, for persons, the shape of its words."""
    bare = F.trim(text)
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    plain = (bare != "") & (F.length(bare) <= LONGEST) & ~bare.rlike(r"[\n\t]|\.\s+[A-Z]|[,;:!?]$") & (F.size(words) > 0) & ~F.exists(words, lambda w: F.lower(w).isin(*PRONOUNS))
    letters = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    shaped = F.forall(words, lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*NEWS) & (letters(w) >= F.greatest(F.lit(2), F.length(w) - 1)))
    company = F.exists(F.array(*map(F.lit, COMPANIES)), lambda c: bare.endswith(c))
    person = F.size(words).between(2, 5) & shaped & ~company
    other = F.forall(words, lambda w: w.rlike(r"^[\p{L}\p{N}]"))
    return F.coalesce(plain & F.when(kind == "person", person).when(kind.isin("org", "place", "project", "event"), other).otherwise(F.lit(True)), F.lit(False))


def validated(raw: DataFrame) -> DataFrame:
    """raw claims with names stripped, the first reason to reject each (null: accepted) and whether a prefix went.

    Columns: subject_text, subject_type, predicate, object_text, object_type, raw_quote; others stay.
    """
    subject, target = headline_stripped(F.col("subject_text")), headline_stripped(F.col("object_text"))
    rows = raw.withColumn("__s", subject).withColumn("__o", target)
    reason = (
        F.when(~F.coalesce(F.col("predicate").isin(*PREDICATES), F.lit(False)), "invalid_predicate")
        .when(~F.coalesce(F.col("subject_type").isin(*ENTITY_TYPES), F.lit(False)), "invalid_subject_type")
        .when(F.col("object_type").isNotNull() & ~F.col("object_type").isin(*OBJECT_TYPES), "invalid_object_type")
        .when(F.trim(F.coalesce("raw_quote", F.lit(""))) == "", "empty_quote")
        .when(~valid_name(F.coalesce("__s.text", F.lit("")), F.col("subject_type")), "invalid_subject")
        .when((F.coalesce("__o.text", F.lit("")) != "") & ~valid_name(F.col("__o.text"), F.coalesce("object_type", F.lit("org"))), "invalid_object")
    )
    out = rows.withColumn("reason", reason).withColumn("rewritten", F.col("__s.changed") | F.col("__o.changed"))
    return out.withColumn("subject_text", F.col("__s.text")).withColumn("object_text", F.col("__o.text")).drop("__s", "__o")


def split_claims(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, audit): accepted raw claims, and an audit row for each rejected or rewritten one."""
    accepted = checked.filter("reason is null").drop("reason", "rewritten")
    payload = F.to_json(F.struct("subject_text", "predicate", "object_text", "object_type", "raw_quote", F.coalesce("reason", F.lit("headline_prefix_stripped")).alias("reason")))
    audit = checked.filter("reason is not null or rewritten").select("raw_id", F.lit("extraction.claim_rejected").alias("action"), payload.alias("payload"))
    return accepted, audit


def repaired_years(raw: DataFrame, class_year) -> DataFrame:
    """Class-year claims with the year read from the object, else from the quote."""
    year = F.coalesce(class_year(F.col("object_text")), class_year(F.col("raw_quote"))).cast("string")
    return raw.withColumn("object_text", F.when(F.col("predicate") == "class_year", F.coalesce(year, "object_text")).otherwise(F.col("object_text")))


def invalid_people(entities: DataFrame, *attached: DataFrame) -> DataFrame:
    """(entity_id, name, action): persons whose name is no name; archived if nothing refers to them, else flagged."""
    bad = entities.filter((F.col("kind") == "person") & ~valid_name(F.col("name"), F.lit("person"))).select("entity_id", "name")
    used = attached[0].select("entity_id")
    for more in attached[1:]:
        used = used.unionByName(more.select("entity_id"))
    used = used.distinct().withColumn("used", F.lit(True))
    return bad.join(used, "entity_id", "left").select("entity_id", "name", F.when(F.col("used"), "flag").otherwise("archive").alias("action"))
