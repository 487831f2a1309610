import random

import xxhash

from strandline.llm import simhash
from strandline.llm.components import component_labels


def brute_print(text):
    low = (text or "").encode().decode()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in low)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def brute_components(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows))


def found(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    return sorted((str(r.doc_id), r.h, r.component_id) for r in simhash.simhash_components(docs).select("doc_id", simhash.fingerprint_hex().alias("h"), "component_id").collect())


def near_copies(rng, n):
    vocabulary = ["W%d" % i for i in range(60)] + ["été", "ß", "日本"]
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            if words and rng.random() < 0.8:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 40, 120, 300]))
        rows.append((d * 7 + 3, rng.choice([" ", "\n", " \t"]).join(words)))
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    rows = near_copies(random.Random(1), 220)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (rows[0][0], rows[0][1]), (None, rows[1][1]), (None, "alone in here, quite alone")]
    assert found(spark, rows) == brute_components(rows)


def test_links_and_labels_on_dense_fingerprints(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(150)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    labels = {r.node: r.label for r in component_labels(simhash.links(frame), "a", "b").collect()}
    parent = dict(zip(signed, signed, strict=True))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {p: labels.get(p, p) for p in signed} == {p: root(p) for p in signed}


def test_representatives_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (2, "other words stand here now", "z")], "doc_id long, text string, __x string")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    labels = {r.node: r.label for r in component_labels(edges, "a", "b").collect()}
    assert set(labels.values()) == {0, 500} and len(labels) == 203
