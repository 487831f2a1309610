"""Secret scans by character Markov models, in DataFrame operations only.

Base rules find assignments, access keys and long hex runs. The method adds tokens that look like random strings: two
first-order Markov chains over character classes, one of random strings and one of ordinary identifiers, score each
candidate by its mean log-likelihood ratio. Both chains are trained on labelled samples: random strings made from
digests by rule, and identifiers composed from words of the corpus, taken from SAMPLE_DOCS documents (those of least
hash, a bounded sample). The threshold is calibrated on identifiers and random strings that were held out of the
training: halfway between the two, where they leave room.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .textkit import least_hash_sample

#: The documents whose words the identifier model is trained on, and the random strings made for the other model.
SAMPLE_DOCS, SAMPLE_STRINGS = 100, 2000
#: Shares of held-out identifiers above the threshold and of held-out random strings below it, and the least threshold in nats a character.
FALSE_RATE, MISSED_RATE, LEAST_RATIO = 1e-4, 0.005, 0.25
#: Weight of the single-character distribution in each row of a chain, in observations.
PRIOR = 20.0
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run fails or passes whole, so least lengths in the pattern equal dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"[A-Za-z0-9+/_-]{20,}+"
#: Cheap necessary condition of any span.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[A-Za-z0-9+/_-]{20}"

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_STATES = len(_ALPHABET) + 1  # state 0 stands for the start and for any other character


def steps(token: Column) -> Column:
    """The chain's steps as numbers from 1: previous state * states + state + 1."""

    states = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), _state)
    return F.get(F.transform(F.array(states), lambda s: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(s, F.lit(1), F.size(s) - 1)), s, lambda a, b: a * _STATES + b + 1)), F.lit(0))


def _state(char: Column) -> Column:
    return F.instr(F.lit(_ALPHABET), char)


def _samples(docs: DataFrame) -> DataFrame:
    """(label, part, token): 1 for random strings, 0 for identifiers; part 0..9 tells training from calibration."""
    spark = docs.sparkSession
    made = spark.range(SAMPLE_STRINGS).select(F.col("id").cast("string").alias("n"))
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("n")), 256)
    encoded = F.base64(F.unhex(F.concat(digest("a"), digest("b"))))
    kinds = [
        F.substring(digest("c"), 1, 40),
        F.regexp_replace(F.substring(encoded, 1, 40), "=", "x"),
        F.translate(F.regexp_replace(F.substring(encoded, 1, 32), "[+/=]", "7"), "+/", "-_"),
        F.upper(F.regexp_replace(F.substring(encoded, 1, 24), "[+/=]", "Q")),
    ]
    random = made.select(F.explode(F.array(*kinds)).alias("token")).select(F.lit(1).alias("label"), "token")
    text = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    some = least_hash_sample(text, "text", SAMPLE_DOCS)
    plainly = F.regexp_replace("text", TOKEN, " ")  # what may be a secret itself teaches no identifiers
    words = some.select(F.regexp_extract_all(plainly, F.lit(r"[A-Za-z]{3,}"), F.lit(0)).alias("w")).filter("size(w) > 3")
    other = lambda i, step, start: F.get("w", (i * step + start) % F.size("w"))
    groups = words.select(F.posexplode(F.transform("w", lambda a, i: F.struct(a.alias("a"), other(i, 7, 3).alias("b"), other(i, 5, 1).alias("c"), other(i, 11, 2).alias("d")))).alias("i", "p"))
    each = groups.select("i", "p.a", "p.b", "p.c", "p.d")
    b, digit = F.col("b"), (F.col("i") % 10).cast("string")
    camel = F.concat(F.lower("a"), *[F.initcap(x) for x in ("b", "c", "d")])
    forms = [F.col("a"), F.concat_ws("_", "a", b), F.concat("a", F.initcap(b)), F.concat_ws("-", F.lower("a"), F.lower(b), F.col("i").cast("string")), F.concat_ws("/", F.lower("a"), b, F.concat(F.lit("v"), F.col("i") % 10)), F.concat(F.upper("a"), F.lit("_"), F.upper(b), F.lit("_"), F.col("i") % 100), F.concat(camel, digit), F.concat(F.initcap(camel), camel), F.concat_ws("_", F.lower("a"), F.lower(b), F.lower("c"), F.lower("d"), digit)]
    plain = each.select(F.explode(F.array(*forms)).alias("token")).select(F.lit(0).alias("label"), "token").distinct()
    return random.union(plain).withColumn("part", F.pmod(F.xxhash64("token"), F.lit(10)))


def train(docs: DataFrame) -> tuple[list[float], float]:
    """(log-likelihood ratio of each step, threshold): a table of fixed size, whatever the corpus."""
    samples = _samples(docs).persist()
    try:
        counted = samples.filter("part < 7").select("label", F.explode(steps(F.col("token"))).alias("step")).groupBy("label", "step").count().collect()  # at most 2 * _STATES ** 2 rows
        logs = []
        for label in (1, 0):
            seen = {r["step"]: r["count"] for r in counted if r["label"] == label}
            rows = [[seen.get(a * _STATES + b + 1, 0) for b in range(_STATES)] for a in range(_STATES)]
            into = [sum(column) + 0.5 for column in zip(*rows, strict=True)]
            alone = [x / sum(into) for x in into]  # rows with few samples lean on how common a character is at all
            table = [math.log((n + PRIOR * p) / (sum(row) + PRIOR)) for row in rows for n, p in zip(row, alone, strict=True)]
            logs.append(table)
        ratios = [x - y for x, y in zip(*logs, strict=True)]
        held = samples.filter("part >= 7 and length(token) >= 20").select("label", ratio(F.col("token"), ratios).alias("x"))
        top, low = held.agg(F.percentile(F.when(F.col("label") == 0, F.col("x")), F.lit(1 - FALSE_RATE)), F.percentile(F.when(F.col("label") == 1, F.col("x")), F.lit(MISSED_RATE))).first()
        top = LEAST_RATIO if top is None else max(LEAST_RATIO, top)
        return ratios, (top + low) / 2 if low is not None and low > top else top  # as far from either as there is room
    finally:
        samples.unpersist()


def ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio a character: above 0 the random strings explain the token better."""
    table = F.lit(ratios)
    return F.aggregate(steps(token), F.lit(0.0), lambda total, s: total + F.element_at(table, s)) / F.greatest(F.length(token), F.lit(1))


def base_spans(text: Column) -> Column:
    assign = F.filter(spans.matches("assign", text, ASSIGN, 2), lambda m: F.length(m["part"]) >= 8)
    return F.concat(assign, spans.matches("access", text, ACCESS), spans.matches("hex", text, HEX))


def random_spans(text: Column, model: tuple[list[float], float]) -> Column:
    """Tokens of 20 characters or more, with letters and digits, that the model calls random."""
    ratios, threshold = model
    tokens = F.filter(spans.matches("random", text, TOKEN), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    return F.filter(tokens, lambda m: ratio(m["value"], ratios) > threshold)


def secret_spans(docs: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """docs with `base` and `added`, arrays of (kind, start, end, value, part, before) spans in code points, end exclusive.

    Base spans may overlap across kinds; added spans overlap no base span. Null and empty texts have no spans; every row
    keeps its place, repeated ones too. An empty table trains on the made strings alone and gives no rows. Columns of
    these two names are replaced. Very long texts are taken whole; the work is about linear in their matches.
    """
    model = model or train(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worth = text.rlike(_ANY)
    base = docs.withColumn("base", F.when(worth, base_spans(text)).otherwise(spans.none()))
    return base.withColumn("added", F.when(worth, spans.without_overlap(random_spans(text, model), F.col("base"), tuple(KINDS)[:3])).otherwise(spans.none()))


def redacted(docs: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """docs with every secret span of the text replaced by [SECRET]; all rows and columns stay."""
    found = secret_spans(docs.select(F.col("text"), F.struct(*docs.columns).alias("__row")), model)
    out = found.withColumn("__text", spans.replaced(F.col("text"), F.concat("base", "added"), "[SECRET]"))
    return out.select(*[F.col("__text").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans.text_of(F.col("base"), KINDS, by_kind=False), 256).alias("base_sha256"),
        spans.text_of(F.concat("base", "added"), KINDS, by_kind=False).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
