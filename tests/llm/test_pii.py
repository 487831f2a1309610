import hashlib
import random
import re
import time

import pytest

from strandline.llm import pii

KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def base(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda s: (KINDS[s[0]], s[1]))


def texts():
    rng = random.Random(13)
    out = [None, "", "plain words", "a@b.c..foo@bar.com a@b.c_d@e.f @x.y x@ a@b", "😀 +1 (555) 123-4567 é +44 20 7946 0958 4111 1111 1111 1111", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255", "4111-1111-1111-1112 4111111111111111", "a@" + "b." * 20000 + "c", "9" * 50_000 + " " + "x" * 50_000, "+1" + "(" * 5000 + "2"]
    for alphabet in ("ab@.-_+ 1", "0123456789 .-", "+0123456789()-. x", "4105 -"):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(120)]
    return out


EXTRA = {
    5000: ("write to jane.roe [at] example [dot] com today", "jane.roe [at] example [dot] com"),
    5001: ("call 555-123-4567 after nine", "555-123-4567"),
    5002: ("IBAN DE44 5001 0517 5407 3249 31 please", "DE44 5001 0517 5407 3249 31"),
    5003: ("ssn: 078-05-1120 on file", "078-05-1120"),
    5004: ("order 1234567890 and 2021-01-02 11 are fine, meet at noon.today", None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(texts())) + [(k, v[0]) for k, v in EXTRA.items()] + [(4, texts()[4]), (None, texts()[3])]
    docs = spark.createDataFrame([(d, t, "b") for d, t in rows], "doc_id long, text string, base string")
    return dict(rows), len(rows), pii.digest(pii.personal_spans(docs)).collect()


def test_base_spans_match_python(found):
    lookup, n, got = found
    assert len(got) == n
    for r in got:
        want = base(lookup[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in want) for k in KINDS], lookup[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in KINDS] == [s for s in joined.split(",") if s]


def test_boosted_candidates_add_only_personal_data(found):
    lookup, _, got = found
    for r in got:
        if r.doc_id in EXTRA:
            more = [lookup[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k not in KINDS]
            assert more == ([EXTRA[r.doc_id][1]] if EXTRA[r.doc_id][1] else [])


def test_empty_table(spark):
    assert pii.personal_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hundred_thousand_matches_in_one_text(spark):
    docs = spark.createDataFrame([(1, "1.2.3.4 é ab 555-123-4567 x " * 100_000)], "doc_id long, text string")
    model = pii.train(docs.limit(0))
    began = time.time()
    got = pii.digest(pii.personal_spans(docs, model)).first()
    assert got.n_ip == 100_000 and got.n_phone == 0
    assert time.time() - began < 90
