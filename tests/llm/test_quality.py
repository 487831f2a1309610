import random
import re

import numpy as np

from strandline.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def texts(rng):
    out = [None, "", " \n\t", "a", "é b ß\n\nx\ny\nx\n", "a b c d e " * 9, "one\none\none \none", "no newline at end\n" * 4 + "no newline at end", "# * $ % & | < > #x", "日本 語 " * 400]
    for _ in range(150):
        out.append("".join(rng.choice(["w%d " % rng.randrange(6), "x\n", "é ", "# ", "\n", "\x0b", "long%d " % rng.randrange(900)]) for _ in range(rng.randrange(220))))
    return out


def test_counts_match_brute_force(spark):
    rows = [(i, t, rng_lang, "s", 5) for i, t in enumerate(texts(random.Random(3))) for rng_lang in ("en",)]
    rows += [(4, rows[4][1], "en", "s", 5), (None, "x y", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = q.digest(q.verdicts(docs)).collect()
    assert len(got) == len(rows)
    lookup = {i: t for i, t, *_ in rows}
    for r in got:
        want = brute(lookup[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept is False if r.base_failed else r.kept in (True, False)


def test_estimate_matches_numpy(spark):
    rng = np.random.default_rng(5)
    names = list(q.FEATURES)
    data = np.round(rng.normal(size=(400, len(names))) * 0.4 + 1, 3)
    data[:40] += 9
    frame = spark.createDataFrame([("c", *map(float, x)) for x in data], "cell string, " + ", ".join(f"{n} double" for n in names))
    got = q.fit(frame).first()
    floor = np.diag(np.square(list(q.FEATURES.values())))
    centre = np.median(data, axis=0)
    mad = np.median(np.round(np.abs(data - centre), 3), axis=0) * 1.4826
    unit = np.sqrt(mad**2 + np.diag(floor))
    signs = (data - centre) / unit
    signs /= np.maximum(np.linalg.norm(signs, axis=1, keepdims=True), 1e-9)
    found = [(centre, np.diag(mad**2)), (centre, signs.T @ signs / len(data) * np.outer(unit, unit) * len(names)), (data.mean(axis=0), np.cov(data.T, bias=True))]
    logdet = lambda c: np.linalg.slogdet(c + floor)[1]
    for step in range(q.MOST_STEPS):
        after = []
        for mean, cov in found:
            away = data - mean
            far = np.round(np.log1p(np.einsum("ni,ij,nj->n", away, np.linalg.inv(cov + floor), away)), 2)
            inner = data[far <= np.quantile(far, q.SUBSET) + 0.005]
            after.append((inner.mean(axis=0), np.cov(inner.T, bias=True)))
        fallen = max(logdet(a[1]) - logdet(b[1]) for a, b in zip(found, after, strict=True))
        found = after
        if step and fallen <= q.SETTLED:
            break
    mean, cov = min(found, key=lambda x: round(logdet(x[1]), 9))
    assert np.allclose(got.mean, mean) and np.allclose(np.array(got.precision).reshape(cov.shape), np.linalg.inv(cov + floor))
    assert abs(got.mean[0] - 1) < 0.2  # the tenth of outliers has no part in it


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(4)
    words = ["river", "stone", "window", "market", "garden", "people", "letter", "around", "another", "between"]
    clean = [(i, " ".join("".join(rng.sample("abcdefgh", 3)) + rng.choice(words) for _ in range(rng.randrange(40, 200))), "en", f"s{i % 3}", i) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in clean[i][1].split()), "en", "s0", i) for i in range(9)] + [(2000, clean[5][1].upper().replace(" ", "!! "), "en", "s1", 0)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, cell int")
    kept = q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(300))


def test_empty_table(spark):
    assert q.verdicts(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_long_lines_and_words_are_told_apart(spark):
    flags = [bin(i).count("1") & 1 for i in range(1024)]
    one, other = "".join("ab"[f] for f in flags), "".join("ba"[f] for f in flags)
    long = "\n".join(f"line {i} of many" for i in range(150_000))  # over one slice
    rows = [(1, f"{one}\n{other}"), (2, f"{one}\n{other}\n{one}"), (3, f"{long}\nline 7 of many")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.n_dup_lines for r in q.text_statistics(docs).collect()} == {1: 0, 2: 1, 3: 1}
