import itertools
import random
import re
import time

import numpy as np

from strandworks.llm import pii as P

# the patterns as they are stated
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(d) <= 19 and P.luhn(d) or k == "phone" and 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2]), s[1]))


def test_base_matches_plain_patterns():
    r = random.Random(4)
    parts = ["a", "b.c", "@", "@x.y", "x@", ".", "..", "1", "12", "255", "256", "+", "+1", " ", "-", "--", "(", ")", "4111111111111111", "4111 1111-1111 1111", "é", "\n", "000", "%", "_"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        assert P.base(t) == brute(t), t


def test_long_texts_in_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "1 " * 60_000, "a@" * 100_000):
        P.base(t)


def test_all_spans_in_linear_time():
    w = P.fitted()
    part = "a.b@c.de 10.1.2.3 555 0187 12-34 4111 1111 1111 1111 and 10.0.0.300 +1 212 555 0187 x9 "
    took = []
    for n in (500, 2000):
        began = time.time()
        P.spans(part * n, w)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1


# written by hand: text, spans that must be found beyond the base patterns, and texts that hold none
FOUND = [
    ("Ring the shop on 020 7946 0958 before noon.", ["020 7946 0958"]), ("my mobile: 07700 900123", ["07700 900123"]),
    ("Tel. 01 23 45 67 89, ask for Anne", ["01 23 45 67 89"]), ("call (212) 555-0187 or 212.555.0143", ["(212) 555-0187", "212.555.0143"]),
    ("Our office (0161) 496 0000 is open", ["(0161) 496 0000"]), ("fax 1-800-555-0199.", ["1-800-555-0199"]),
    ("write to jane.doe @ example.org please", ["jane.doe @ example.org"]), ("dial 0044 20 7946 0991 from abroad", ["0044 20 7946 0991"]),
    ("paid with 4111.1111.1111.1111 today", ["4111.1111.1111.1111"]),
]
CLEAN = [
    "version 10.0.0.300 of the tool", "from 2021-03-04 12:30 to 2021-03-05", "it cost 1,250,000.00 in 1999", "ISBN 978-3-16-148410-0", "order 12345-678901-22",
    "pi is 3.14159265358979", "between 1914 and 1918, and 1939 to 1945", "a score of 21-19, 15-21, 22-20", "room 12 on floor 3 of 45", "the 7 of 9 and 3 of 5",
]


def test_hand_written_texts():
    w = P.fitted()
    for text, want in FOUND:
        assert [text[a:b] for a, b, _ in P.spans(text, w)[1]] == want, text
    for text in CLEAN:
        assert P.spans(text, w)[1] == [], text


def segmentations(n, found):
    for k in range(len(found) + 1):
        for pick in itertools.combinations(range(len(found)), k):
            spans = sorted(found[r][:2] for r in pick)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                yield pick


def test_programs_match_enumeration():
    r = np.random.default_rng(2)
    for _ in range(30):
        n = 6
        found = [(i, j, "phone") for i in range(n) for j in range(i + 1, n + 1) if r.random() < 0.4][:9]
        score = r.normal(size=len(found)) * 2
        every = list(segmentations(n, found))
        total = [score[list(p)].sum() for p in every]
        z, prob = P.expected(n, found, score)
        assert abs(z - np.logaddexp.reduce(total)) < 1e-9
        for k in range(len(found)):
            assert abs(prob[k] - sum(np.exp(t - z) for p, t in zip(every, total) if k in p)) < 1e-9
        assert abs(score[P.decode(n, found, score)].sum() - max(total)) < 1e-9


def test_held_out_sentences():
    w = P.fitted()
    hit = extra = want = 0
    for text, gold in P.examples(200, seed=99):
        got = set(P.spans(text, w)[1])
        hit += len(got & set(gold))
        extra += len(got - set(gold))
        want += len(gold)
    assert hit / want > 0.97 and extra / want < 0.05, (hit, extra, want)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "call (212) 555-0187, or a.b@c.de", "x"), (None, "é +1 (743) 555-3824 é", "x"), (5, "nothing here", "x"), (6, "w " * 50_000 + "10.0.0.1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = P.find(docs, clean=True).collect()
    assert [r.spans for r in got] == ["", "", "phone:5:19,email:24:32", "phone:2:19", "", "ip:100000:100008"]
    assert got[2].n_email == 1 and got[2].n_phone == 0 and got[2].cleaned == "call <PHONE>, or <EMAIL>" and got[0].cleaned is None
    assert P.find(docs.limit(0)).count() == 0
