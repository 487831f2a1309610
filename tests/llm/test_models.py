"""The trained parts of op4, op5 and op10 against plain versions of their scores, and on labelled cases written apart from
their training samples: recall and precision a form or kind."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, pii, secrets

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).select("doc_id", "text")


# op10


@pytest.fixture(scope="module")
def chains(docs):
    return secrets.train(docs)


def plain_ratio(token, ratios):
    states = [secrets._ALPHABET.find(c) + 1 for c in token]
    return sum(ratios[a * secrets._STATES + b] for a, b in zip([0, *states], states, strict=False)) / len(token)


def random_tokens(rng):
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return {
        "forty of base64": pick(string.ascii_letters + string.digits + "+/", 40),
        "prefix and 36": "ghp_" + pick(string.ascii_letters + string.digits, 36),
        "url-safe 43": pick(string.ascii_letters + string.digits + "-_", 43),
        "upper and digits 32": pick(string.ascii_uppercase + string.digits, 32),
        "lower and digits 32": pick(string.ascii_lowercase + string.digits, 32),
        "live key": "sk_live_" + pick(string.ascii_letters + string.digits, 24),
    }


WORDS = "harbour light north delta ferry winter storm captain message counter service request handler update status version library window session storage pipeline document language transfer matrix".split()


def ordinary_tokens(rng):
    w = lambda n: rng.sample(WORDS, n)
    return {
        "camel case": w(1)[0] + "".join(x.title() for x in w(3)) + str(rng.randrange(10)),
        "snake case": "_".join(w(4)) + f"_{rng.randrange(100)}",
        "path": "/".join(w(4)) + f"/v{rng.randrange(9)}",
        "slug": "-".join(w(4)) + f"-{rng.randrange(2030)}",
        "constant": "_".join(x.upper() for x in w(3)) + f"_{rng.randrange(10)}",
        "date and name": f"2024-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}-{'-'.join(w(2))}",
    }


def test_ratio_equals_a_plain_chain(spark, chains):
    rng = random.Random(1)
    tokens = [t for _ in range(20) for t in (*random_tokens(rng).values(), *ordinary_tokens(rng).values())] + ["x", "é!", "A" * 5000]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.ratio(F.col("t"), chains[0]).alias("r")).collect()
    for r in rows:
        assert abs(r.r - plain_ratio(r.t, chains[0])) < 1e-9


def test_random_tokens_are_told_from_ordinary_ones(spark, chains):
    rng = random.Random(2)
    rows = [(name, kind, f"see {t} there") for _ in range(150) for kind, made in (("random", random_tokens(rng)), ("ordinary", ordinary_tokens(rng))) for name, t in made.items()]
    found = secrets.secret_spans(spark.createDataFrame(rows, "form string, kind string, text string"), chains)
    share = {(r.kind, r.form): r.hit for r in found.groupBy("kind", "form").agg(F.avg((F.size("added") + F.size("base") > 0).cast("int")).alias("hit")).collect()}
    print({k: round(v, 3) for k, v in sorted(share.items())})
    assert all(v >= 0.9 for (kind, _), v in share.items() if kind == "random"), share
    assert all(v <= 0.05 for (kind, _), v in share.items() if kind == "ordinary"), share


# op4


@pytest.fixture(scope="module")
def boosted(docs):
    return pii.train(docs)


LABELLED = [
    ("phone2", lambda r: f"You can reach us: phone {r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}."),
    ("phone2", lambda r: f"Telefon: 0{r.randrange(100, 999)} {r.randrange(1000000, 9999999)}"),
    ("phone2", lambda r: f"call ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)} after noon"),
    ("phone2", lambda r: f"mobile {r.randrange(200, 999)}.{r.randrange(200, 999)}.{r.randrange(1000, 9999)}"),
    ("ssn", lambda r: f"his ssn {r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)} was on it"),
    ("email2", lambda r: f"write to {r.choice(WORDS)}.{r.choice(WORDS)} [at] {r.choice(WORDS)} [dot] org"),
    ("email2", lambda r: f"contact {r.choice(WORDS)}(at){r.choice(WORDS)}.com for more"),
    ("iban", lambda r: f"account DE{r.randrange(10, 99)} {r.randrange(1000, 9999)} {r.randrange(1000, 9999)} {r.randrange(1000, 9999)} {r.randrange(1000, 9999)} {r.randrange(10, 99)}"),
    ("none", lambda r: f"order {r.randrange(10**9, 10**10)} was sent"),
    ("none", lambda r: f"between {r.randrange(1000, 2000)} and {r.randrange(2000, 2030)} the total was {r.randrange(10**5)}.{r.randrange(10, 99)}"),
    ("none", lambda r: f"on 2024-{r.randrange(1, 13):02}-{r.randrange(1, 29):02} {r.randrange(10, 24)}:{r.randrange(10, 60)} it stood at {r.randrange(100)}"),
    ("none", lambda r: f"the {r.choice(WORDS)} at {r.choice(WORDS)} was closed"),
    ("none", lambda r: f"version {r.randrange(100)}.{r.randrange(100)}.{r.randrange(10000)} build {r.randrange(10**8, 10**9)}"),
]


def test_trees_equal_a_plain_sum(spark, boosted):
    """The spans that are added are those whose trees, walked in Python, reach the threshold."""
    rng = random.Random(3)
    rows = [(i, make(rng)) for i, (_, make) in enumerate(LABELLED * 12)]
    df = spark.createDataFrame(rows, "id int, text string")
    n = len(pii.features(F.lit("phone2"), F.lit("1"), F.lit("")))
    scored = df.select("id", F.explode(pii.proposals(F.col("text"))).alias("s")).select("id", "s.start", "s.end", F.array(*[f.cast("double") for f in pii.features(F.col("s.kind"), F.col("s.value"), pii._context(F.col("s")))]).alias("f"))
    trees, threshold = boosted
    want = {(r.id, r.start, r.end) for r in scored.collect() if sum(t.score(r.f) for t in trees) >= threshold}
    got = {(r.id, r.start, r.end) for r in df.select("id", F.explode(pii.added_spans(F.col("text"), boosted)).alias("s")).select("id", "s.start", "s.end").collect()}
    assert n == pii.N_FEATURES and want and got == want


def test_recall_and_precision_of_kinds(spark, boosted):
    rng = random.Random(4)
    rows = [(f"{k}:{i}", k, make(rng)) for _ in range(60) for i, (k, make) in enumerate(LABELLED)]
    found = pii.personal_spans(spark.createDataFrame(rows, "form string, kind string, text string"), boosted)
    share = {r.form: r.hit for r in found.groupBy("form").agg(F.avg((F.size("added") + F.size("base") > 0).cast("int")).alias("hit")).collect()}
    print({k: round(v, 3) for k, v in sorted(share.items())})
    for form, hit in share.items():
        assert hit <= 0.05 if form.startswith("none") else hit >= 0.9, share


# op5


def plain_trigrams(text):
    """A single other character is a space; a longer run ends one word and begins another."""
    marked, run = "", 0
    for c in f" {text.lower()} ":
        if c.isalpha():
            marked, run = marked + c, 0
        else:
            run += 1
            marked += " " if run <= 2 else ""
    return [g for g in (marked[i : i + 3] for i in range(len(marked) - 2)) if "  " not in g]


def test_popcounts_equal_a_plain_filter(spark):
    full = spark.read.parquet(DOCS)
    names, slots, false = model = langid.learn(full)
    texts = [r.text for r in full.filter("text is not null").orderBy("doc_id").limit(60).collect()] + ["Ünïted ---- 42 naïve", "x", "the the the", "a" * 300_000]
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    pick, score = langid.classify(np.frombuffer(b"".join(data), np.uint8), offs, model)
    for i, text in enumerate(texts):
        grams = plain_trigrams(text)
        codes = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in grams], np.uint64)
        at = langid.slots_of(codes)
        counts = []
        for k in range(len(names)):
            bit = lambda s, k=k: (slots[k // 64][s] >> np.uint64(k % 64)) & np.uint64(1)
            hits = sum(int(all(bit(s[j]) for s in at)) for j in range(len(grams)))
            counts.append((hits - len(grams) * false[k]) / (1 - false[k]))
        best = int(np.argmax(counts))
        assert abs(counts[pick[i]] - counts[best]) < 1e-6 and abs(score[i] - min(1, max(0, counts[best] / len(grams)))) < 1e-6, text[:50]
