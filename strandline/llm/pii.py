"""Personal data by candidate generation and gradient boosting, in DataFrame operations only.

High-recall generators propose overlapping spans: runs of digits and separators, and things like addresses with spelled
separators. Boosted depth-limited trees score each by the format of the span and the words before it; thresholds
calibrated on held-out candidates select the additions. Base rules decide emails, addresses, cards and phones by
themselves; what they decide is never taken back.

The trees are grown here, each round from one table of candidate counts by feature vector: all features are small
numbers, so that table is bounded by their number of values, not by the corpus. Labels of corpus candidates come from
the base rules: a proposal that overlaps a base phone or email is personal data, with what decides there (the leading
plus and the country's digits before the proposal) hidden from the features; every other proposal counts as ordinary.
Forms that the base rules do not know are written by rule. Both samples are bounded: SAMPLE_DOCS distinct documents
with a proposal (those of least hash) and MADE spans a form.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .textkit import least_hash_sample

SAMPLE_DOCS, MADE = 400, 3000
ROUNDS, DEPTH, RATE = 12, 2, 0.5
#: Share of the held-out candidates above the threshold that must be personal data.
PRECISION = 0.99
KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "email2": 4, "phone2": 5, "iban": 6, "ssn": 7}

# Possessive repetition of groups runs in a loop, not on the stack. \G lets a match begin where the last one ended; any
# other match begins at the beginning of its run, which a look-behind tells without retries.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

#: Proposals; they overlap base spans and one another, and most are no personal data.
NUMBER = r"(?<![A-Za-z0-9+])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){8,18}+(?![A-Za-z0-9])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({](?:at|AT)[\])}]\x20?|\x20@\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({](?:dot|DOT)[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{1,63}){1,4}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: What a base phone has in front of the part that is proposed.
_HIDDEN = r"\+[0-9\x20().-]*$"
_CUE = r"(?i)(?:phone|tel|call|mobile|cell|fax|mail|contact|ssn|social|iban|account|konto|telefon|t[eé]l[eé]phone|tel[eé]fono|correo|e-mail)[^A-Za-z0-9]{0,4}$"
#: Cheap necessary conditions, so that most texts meet no span expression at all.
_ANY_BASE = r"@|[0-9][\x20-]?[0-9]|[0-9]\.[0-9]|\+[0-9]"
_ANY_MORE = r"[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9]|(?i:[\[({ ]at[\])} ].{1,64}(?:dot|\.))| @ ?[A-Za-z]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test; longer ones are not looked at by the callers."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    def between(value: Column, low: int, high: int) -> Column:
        return F.length(_digits(value)).between(low, high)

    return F.concat(
        F.when(text.contains("@"), spans.matches("email", text, EMAIL)).otherwise(spans.none()),
        F.filter(spans.matches("ip", text, IP), lambda m: m["value"].rlike(_IP_VALID)),
        F.filter(spans.matches("card", text, CARD), lambda m: F.when(between(m["value"], 13, 19), luhn(_digits(m["value"]))).otherwise(F.lit(False))),
        F.when(text.contains("+"), F.filter(spans.matches("phone", text, PHONE), lambda m: between(m["value"], 9, 15))).otherwise(spans.none()),
    )


def proposals(text: Column) -> Column:
    """High-recall candidates of all generators."""
    number = F.transform(spans.matches("phone2", text, NUMBER), lambda m: m.withField("kind", F.when(m["value"].rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").otherwise("phone2")))
    return F.concat(number, spans.matches("email2", text, SPELLED), spans.matches("iban", text, IBAN))


#: Features in order; each is a small whole number.
def features(kind: Column, value: Column, before: Column) -> list[Column]:
    digits = F.length(_digits(value))
    groups = F.size(F.split(value, "[^0-9A-Za-z]+"))
    return [
        F.coalesce(F.create_map(*[F.lit(x) for pair in (("phone2", 0), ("ssn", 1), ("email2", 2), ("iban", 3)) for x in pair])[kind], F.lit(9)),
        F.least(digits, F.lit(20)),
        F.least(groups, F.lit(8)),
        value.rlike(r"[()]").cast("int"),
        F.least(F.length(F.regexp_replace(value, r"[^ -]", "")), F.lit(6)),
        F.least(F.length(F.regexp_replace(value, r"[^.]", "")), F.lit(4)),
        before.rlike(_CUE).cast("int"),
        value.rlike(r"[\[({](?:at|AT|dot|DOT)[\])}]| @|(?i: dot )").cast("int"),
        # Context: what kind of character stands before, and how long the word before is.
        F.when(before.rlike(r"[A-Za-z][^A-Za-z0-9]*$"), 1).when(before.rlike(r"[0-9][^A-Za-z0-9]*$"), 2).when(before.rlike(r"[^A-Za-z0-9\s]\s*$"), 3).otherwise(0),
        F.least(F.length(F.regexp_extract(before, r"([A-Za-z]*)[^A-Za-z]*$", 1)), F.lit(6)),
        value.rlike(r"(?i)[. ](?:com|org|net|edu|io|de|fr|es|co|uk|info)$|\)?(?:com|org|net)$").cast("int"),
    ]


N_FEATURES = 11


def _context(span: Column) -> Column:
    return F.regexp_replace(span["before"], _HIDDEN, "")


def _labelled(docs: DataFrame) -> DataFrame:
    """(f, label, part): feature vectors of proposals, 1 for personal data; part 0..9 tells training from calibration."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = least_hash_sample(text.filter(F.col("text").rlike(_ANY_MORE)), "text", SAMPLE_DOCS)
    based = some.select(F.xxhash64("text").alias("t"), base_spans(F.col("text")).alias("base"), proposals(F.col("text")).alias("more"))
    told = F.struct(*[spans.of_kind(F.col("base"), k).alias(k) for k in ("email", "phone", "ip", "card")])
    marked = based.select("t", F.explode(F.get(F.transform(F.array(told), lambda b: F.transform(F.col("more"), lambda s: F.struct(s.alias("s"), spans.touches(s, b["email"], b["phone"]).alias("hit"), spans.touches(s, b["ip"], b["card"]).alias("other")))), F.lit(0))).alias("x"))
    # Addresses and cards are no kind that is proposed; the rules decide them, and no proposal is judged by them.
    corpus = marked.filter("not x.other").select(*[f.alias(f"f{i}") for i, f in enumerate(features(F.col("x.s.kind"), F.col("x.s.value"), _context(F.col("x.s"))))], F.col("x.hit").cast("int").alias("label"), F.xxhash64("t", "x.s.start").alias("h"))
    n = F.col("id")
    d = lambda salt, size: F.lpad(F.pmod(F.xxhash64(F.lit(salt), n), F.lit(10**size)).cast("string"), size, "0")
    word = lambda salt: F.translate(F.substring(F.sha2(F.concat(F.lit(salt), n.cast("string")), 256), 1, 7), "0123456789", "ghijklmnop")
    cue = F.element_at(F.array(*[F.lit(c) for c in ("phone ", "call ", "tel: ", "Telefon ", "contact ")]), (F.pmod(n, F.lit(5)) + 1).cast("int"))
    noise = F.element_at(F.array(*[F.lit(c) for c in ("order ", "total ", "in ", "id ", "the ")]), (F.pmod(n, F.lit(5)) + 1).cast("int"))
    made = [
        (1, "phone2", F.concat(F.lit("("), d("a", 3), F.lit(") "), d("b", 3), F.lit("-"), d("c", 4)), noise),
        (1, "phone2", F.concat(d("a", 3), F.lit("-"), d("b", 3), F.lit("-"), d("c", 4)), cue),
        (1, "phone2", F.concat(d("a", 3), F.lit("."), d("b", 3), F.lit("."), d("c", 4)), cue),
        (1, "phone2", F.concat(F.lit("0"), d("a", 3), F.lit(" "), d("b", 7)), cue),
        (1, "ssn", F.concat(d("a", 3), F.lit("-"), d("b", 2), F.lit("-"), d("c", 4)), cue),
        (1, "email2", F.concat(word("a"), F.lit(" [at] "), word("b"), F.lit(" [dot] com")), noise),
        (1, "email2", F.concat(word("a"), F.lit("(at)"), word("b"), F.lit(".org")), noise),
        (1, "email2", F.concat(word("a"), F.lit(" @ "), word("b"), F.lit(".net")), cue),
        (1, "iban", F.concat(F.lit("DE"), d("a", 2), F.lit(" "), d("b", 4), F.lit(" "), d("c", 4), F.lit(" "), d("e", 4), F.lit(" "), d("f", 4), F.lit(" "), d("g", 2)), noise),
        (0, "phone2", d("a", 10), noise),
        (0, "phone2", d("a", 16), noise),
        (0, "phone2", d("a", 9), noise),
        (0, "phone2", F.concat(d("a", 4), F.lit(" "), d("b", 4), F.lit(" "), d("c", 4)), noise),
        (0, "phone2", F.concat(d("a", 4), F.lit(" "), d("b", 4), F.lit(" "), d("c", 4), F.lit(" "), d("e", 4), F.lit(" "), d("f", 2)), noise),
        (0, "phone2", F.concat(d("a", 4), F.lit(" "), d("b", 4), F.lit(" "), d("c", 4), F.lit(" "), d("e", 4), F.lit(" "), d("f", 2)), cue),
        (0, "phone2", F.concat(d("a", 2), F.lit("."), d("b", 2), F.lit("."), d("c", 4), F.lit(" "), d("e", 2)), noise),
        (0, "phone2", F.concat(d("a", 4), F.lit("-"), d("b", 2), F.lit("-"), d("c", 2), F.lit(" "), d("e", 2)), noise),
        (0, "phone2", F.concat(d("a", 4), F.lit(" "), d("b", 4), F.lit(" "), d("c", 4), F.lit(" "), d("e", 4)), noise),
        (0, "phone2", F.concat(d("a", 3), F.lit("."), d("b", 3), F.lit("."), d("c", 3), F.lit("."), d("e", 3)), noise),
        (0, "email2", F.concat(word("a"), F.lit(" at "), word("b"), F.lit("."), word("c")), noise),
        (0, "iban", F.concat(F.lit("AB"), d("a", 2), F.upper(word("b")), F.upper(word("c"))), noise),
    ]
    rows = docs.sparkSession.range(MADE)
    built = rows.select("id", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), value.alias("value"), before.alias("before")) for label, kind, value, before in made])).alias("m"))
    built = built.select(*[f.alias(f"f{i}") for i, f in enumerate(features(F.col("m.kind"), F.col("m.value"), F.col("m.before")))], F.col("m.label").alias("label"), F.xxhash64("id", "m.value").alias("h"))
    return corpus.union(built).withColumn("part", F.pmod(F.col("h"), F.lit(10)))


class Tree:
    """A regression tree over feature vectors: a leaf value, or (feature, bound, left, right) with left where f <= bound."""

    def __init__(self, value: float = 0.0, split: tuple | None = None):
        self.value, self.split = value, split

    def score(self, f) -> float:
        if self.split is None:
            return self.value
        i, bound, left, right = self.split
        return (left if f[i] <= bound else right).score(f)

    def column(self, f: list[Column]) -> Column:
        if self.split is None:
            return F.lit(self.value)
        i, bound, left, right = self.split
        return F.when(f[i] <= bound, left.column(f)).otherwise(right.column(f))


def _grow(rows: list[tuple[tuple, float, float]], depth: int) -> Tree:
    """rows: (features, gradient, curvature) sums; splits by the usual second-order gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for i in range(N_FEATURES):
            by: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for f, a, b in rows:
                by[f[i]][0] += a
                by[f[i]][1] += b
            left_g = left_h = 0.0
            for bound in sorted(by)[:-1]:
                left_g, left_h = left_g + by[bound][0], left_h + by[bound][1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, i, bound)
    if best is None or best[0] < 1e-6:
        return Tree(RATE * g / (h + 1))
    _, i, bound = best
    return Tree(split=(i, bound, _grow([r for r in rows if r[0][i] <= bound], depth - 1), _grow([r for r in rows if r[0][i] > bound], depth - 1)))


def train(docs: DataFrame) -> tuple[list[Tree], float]:
    """(trees, threshold): boosted on counts by feature vector; the threshold keeps PRECISION on held-out candidates."""
    names = [f"f{i}" for i in range(N_FEATURES)]
    # At most as many rows as there are feature vectors: small numbers all.
    table = _labelled(docs).groupBy(*names, "label", (F.col("part") >= 7).alias("held")).count().collect()
    rows = sorted((tuple(r[n] for n in names), r["label"], r["count"], r["held"]) for r in table)
    vectors = sorted({r[0] for r in rows})
    trained = {v: [0, 0] for v in vectors}
    held = {v: [0, 0] for v in vectors}
    for v, label, n, is_held in rows:
        (held if is_held else trained)[v][label] += n
    score, trees = dict.fromkeys(vectors, 0.0), []
    for _ in range(ROUNDS):
        grads = []
        for v in vectors:
            p = 1 / (1 + math.exp(-score[v]))
            n0, n1 = trained[v]
            if n0 + n1:
                grads.append((v, n1 - (n0 + n1) * p, (n0 + n1) * p * (1 - p)))
        tree = _grow(grads, DEPTH)
        trees.append(tree)
        for v in vectors:
            score[v] += tree.score(v)
    # Calibration: from the top, the lowest score down to which the held-out candidates stay pure.
    good = bad = 0
    threshold = math.inf
    for v in sorted(vectors, key=lambda x: -score[x]):
        good, bad = good + held[v][1], bad + held[v][0]
        if good + bad and good / (good + bad) >= PRECISION:
            threshold = score[v]
        elif bad and good / (good + bad) < PRECISION:
            break
    return trees, threshold


def added_spans(text: Column, model: tuple[list[Tree], float]) -> Column:
    trees, threshold = model

    def score(s: Column) -> Column:
        f = features(s["kind"], s["value"], _context(s))
        keyed = F.struct(*[x.alias(f"f{i}") for i, x in enumerate(f)])
        # One struct of features a span, so that each is computed once and not in every tree.
        return F.aggregate(F.array(keyed), F.lit(0.0), lambda total, x: total + sum((t.column([x[f"f{i}"] for i in range(N_FEATURES)]) for t in trees), F.lit(0.0)))

    return F.filter(proposals(text), lambda s: score(s) >= F.lit(threshold))


def _outermost(chosen: Column) -> Column:
    """Of accepted spans within a longer accepted one, the longer stands for both."""
    # The spans of one generator are sorted and free of overlaps.
    lists = F.struct(F.filter(chosen, lambda s: s["kind"].isin("phone2", "ssn")).alias("a"), spans.of_kind(chosen, "email2").alias("b"), spans.of_kind(chosen, "iban").alias("c"))

    def inside(s: Column, more: Column) -> Column:
        over = spans.last_before(more, s["start"] + 1)
        return F.coalesce((over["end"] >= s["end"]) & (over["end"] - over["start"] > s["end"] - s["start"]), F.lit(False))

    return F.get(F.transform(F.array(lists), lambda x: F.filter(chosen, lambda s: ~(inside(s, x["a"]) | inside(s, x["b"]) | inside(s, x["c"])))), F.lit(0))


def personal_spans(docs: DataFrame, model: tuple[list[Tree], float] | None = None) -> DataFrame:
    """docs with `base` and `added`, arrays of (kind, start, end, value, part, before) in code points, end exclusive.

    Base spans may overlap across kinds; added spans overlap no base span. Null and empty texts have none; every row
    stays, repeated ones too; an empty table trains on the made samples alone. Columns of these two names are replaced.
    Very long texts are taken whole; the work is about linear in their matches.
    """
    model = model or train(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("base", F.when(text.rlike(_ANY_BASE), base_spans(text)).otherwise(spans.none()))
    out = out.withColumn("added", F.when(text.rlike(_ANY_MORE), added_spans(text, model)).otherwise(spans.none()))
    return out.withColumn("added", spans.without_overlap(_outermost(F.col("added")), F.col("base"), tuple(KINDS)[:4]))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(spans.text_of(F.col("base"), KINDS, by_kind=True), 256).alias("base_sha256"),
        spans.text_of(F.concat("base", "added"), KINDS, by_kind=True).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
