import hashlib
import re

from strandline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[s : s + 13]), set()).add(i)
    out = []
    for k, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, who in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids |= {str(x) for x in who if x is not None}
        out.append((str(k), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


ITEM = "The quick brown FOX jumps over the lazy dog while été sun is 42 high and bright"
ITEMS = [(10, ITEM), (9, "short item here"), (2, "a a a"), (None, "nameless item of words"), (11, ""), (12, None), (13, "!!! --"), (9, "short item here"), (14, "SHORT, item; here")]
DOCS = [
    (1, "x " * 30 + ITEM.upper().replace("ÉTÉ", "été") + " y" * 9),
    (2, "a a a a a b a a"),
    (3, None),
    (4, ""),
    (5, "...!!!"),
    (6, "Short-item.here"),
    (6, "Short-item.here"),
    (None, "some nameless item of words"),
    (7, "z " * 400 + "short item here"),
    (8, "the quick brown fox jumps over the lazy dog while ÉTÉ sun is 42 high and bright"),
    (9, "w " * 3000 + " ".join(ITEM.split()[1:15]) + " w" * 3000),
]


def test_contamination_matches_brute_force(spark):
    docs = spark.createDataFrame([(k, t, 7, "c") for k, t in DOCS], "doc_id long, text string, n int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digest(d.contamination(docs, items)).collect())
    assert got == brute(DOCS, ITEMS)
    assert d.digest(d.contamination(docs, items.limit(0))).filter("contaminated or n_items > 0").count() == 0
    assert d.contamination(docs.limit(0), items).count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digest(d.contamination(docs, items)).collect())
    assert got == brute(DOCS, ITEMS)


def test_filter_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(DOCS)], "doc_id long, text string, start int")
    kept = d.decontaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    clean = [i for i, pair in enumerate(DOCS) if not brute([pair], ITEMS)[0][-1]]
    assert sorted(r.start for r in kept.collect()) == clean and len(clean) < len(DOCS)
