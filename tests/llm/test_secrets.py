"""Base patterns against plain regexes; the battery on random and ordinary strings."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from compare import SF
from speechframe.llm import secrets as s


def brute(t):
    t = t or ""
    c = lambda w: "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in w)
    words = "|".join([c("password"), c("passwd"), c("secret"), c("token"), c("api") + "_?" + c("key")])
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest()


RNG = random.Random(4)
TEXTS = [None, "", "PassWord : 'abc.de-f' token=x secret==abcdef", "apikey=12345 api_key=123456 APIKEY: \"zzzzzz\"", "é" * 9 + "AKIA" + "A1" * 8 + "x AKIA" + "B" * 15, "ſecret=abcdefgh toKen=abcdefgh",
         "f" * 23 + " " + "0" * 24 + "g" + "a1" * 40, "token=token=abcdefghij password=AKIA" + "Z9" * 10] + ["".join(RNG.choice("tokensecrapi_=: AKIZ09af\"'é") for _ in range(300)) for _ in range(300)]


def test_base_like_regexes():
    assert all(s.base_digest(t) == brute(t) for t in TEXTS)


def rand(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


TEXT = "it is a truth universally acknowledged that a single man in possession of a good fortune must be in want of a wife however little known the feelings or views of such a man may be on his first entering a neighbourhood"


@pytest.fixture(scope="module")
def model(spark):
    return s.Ordinary(s.letter_pairs(spark.createDataFrame([(TEXT,), (None,), ("",), (TEXT.upper(),)], "text string")))


@pytest.fixture(scope="module")
def learned(spark):
    """Letter pairs of the driver's documents."""
    return s.Ordinary(s.letter_pairs(spark.read.parquet(f"{SF}/documents.parquet")))


def test_letter_pairs_like_counting(spark):
    want = Counter(a + b for a, b in zip(TEXT.lower(), TEXT.lower()[1:]) if a.isalpha() and b.isalpha())
    got = s.letter_pairs(spark.createDataFrame([(TEXT,), (None,), ("É" + TEXT.upper(),)], "text string"))
    assert got.sum() == 2 * sum(want.values()) and all(got[ord(k[0]) - 97, ord(k[1]) - 97] == 2 * n for k, n in want.items())
    assert s.letter_pairs(spark.createDataFrame([], "text string")).sum() == 0


def passes(x, model):
    """Whether the battery lets it pass at 0.001 and the evidence is ten bits."""
    c = s.candidate(x, model)
    return c is not None and c[1] < s.FINE * 10 and c[2] >= 10


@pytest.mark.parametrize("alphabet", [string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"])
@pytest.mark.parametrize("n", [16, 20, 24, 40])
def test_recall_of_short_strings(learned, alphabet, n):
    def one():
        while True:
            x = rand(alphabet, n)
            if any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
                return x

    assert np.mean([passes(one(), learned) for _ in range(400)]) >= 0.9


def test_battery_tells_random_from_ordinary(model):
    plain = ["aaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz123", "some_long_identifier_name_2", "2024-01-01-report-final-version", "version1version1version1version1", "4565410125667261", "thequickbrownfoxjumps", "0000000000000000000000ab",
             "neighbourhood1813", "possessionofafortune42", "section12chapter3page4"]
    assert not any(passes(x, model) for x in plain)


@pytest.mark.parametrize("k", [16, 36, 62])
@pytest.mark.parametrize("n", [16, 32, 64, 200])
def test_the_battery_keeps_its_size(n, k):
    rng = np.random.default_rng(n + k)
    p = [s.uniform_p(rng.integers(0, k, n), k) for _ in range(3000)]
    assert np.mean(np.array(p) < 0.001) <= 0.003 and np.mean(np.array(p) < 0.05) <= 0.07


def test_spans_like_brute_force(spark, docs):
    """Both false-discovery steps by plain sorting of p-values over all runs."""
    rows = [(k, " ".join([TEXT[k % 50 : k % 50 + 60], rand(string.ascii_lowercase + string.digits, RNG.choice([16, 20, 30])) if k % 3 == 0 else "chapter2section17of9" * (1 + k % 4), "x=" + rand(string.ascii_letters + string.digits, 24) if k % 5 == 0 else ""])) for k in range(120)]
    d = docs(rows)
    model = s.Ordinary(s.letter_pairs(d))
    found = [(i, *c) for i, t in rows for a, b in s.runs(t) for c in s.candidates(t, a, b, model)]
    want = set()
    for size in {c[3] for c in found}:
        of = [c for c in found if c[3] == size]
        pass_one = lambda p, m, among: max([q for q in {p(c) for c in among} if q <= s.FDR * sum(p(c) <= q for c in among) / m], default=-1.0)
        even = [c for c in of if 2.0 ** (-c[4] / s.FINE) > pass_one(lambda c: 2.0 ** (-c[4] / s.FINE), len(of), of)]
        if even:
            at = pass_one(lambda c: 2.0 ** -c[5], len(even), even)
            want |= {c[:3] for c in even if 2.0 ** -c[5] <= at}
    got = {(r.doc_id, x.start, x.end) for r in s.scan(d).collect() for x in r.spans if x.kind == "random"}
    base = {(i, a, b) for i, t in rows for _, a, b in s.base_spans(t, s.runs(t))}
    assert got == {w for w in want if not any(w[0] == i and a < w[2] and w[1] < b for i, a, b in base)} and len(got) > 30


def test_scan(spark, docs):
    key = rand(string.ascii_letters + string.digits, 40)
    rows = [(1, None), (2, ""), (3, f"see {key} here"), (4, "nothing at all, ordinary words"), (5, f"token={key}"), (5, f"token={key}"), (6, "w " * 30_000 + key)]
    got = s.scan(docs(rows))
    by = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in got.collect()}
    assert by == {1: [], 2: [], 3: [("random", 4, 44)], 4: [], 5: [("assign", 0, 46)], 6: [("random", 60_000, 60_040)]}
    cut = {r.doc_id: r.text for r in s.scan(docs(rows), redact=True).collect()}
    assert cut[3] == "see [SECRET] here" and cut[4] == rows[3][1] and cut[5] == "[SECRET]" and cut[1] is None
    assert s.scan(docs([])).count() == 0
    d = {r.doc_id: r for r in s.digests(got).collect()}
    assert (d[5].n_assign, d[5].spans, d[3].spans, d[3].base_sha256) == (1, "assign:0:46", "random:4:44", hashlib.sha256(b"").hexdigest())


def test_false_discovery_control_is_stricter_for_more_tests(spark, docs):
    weak = docs([(k, rand("0123456789abcdef", 16)) for k in range(300)])
    cut = s.thresholds(weak, s.Ordinary())
    assert all(2.0 ** -b <= s.FDR for _, b in cut.values())


def test_parts_of_runs_that_fit_no_alphabet(spark, docs):
    key = "K7x" + rand(string.ascii_letters + string.digits, 37)
    aws, dashed = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ4vT8sLmD2h", "q7Zt-Xw9_Lk3vB8nRm2Jd5Hs6Pc1Gf4YaTe0UiOo"
    rows = [(1, f"AWS_ACCESS_KEY={aws} end"), (2, f"auth={key}"), (3, f"see http://h.org/?sig={key}&x=1"), (4, f"to /some-path/of/{key}/the-end"), (5, f"auth={key}=="),
            (6, f"GET /v1/{dashed}/x-y"), (7, "/some-long-path/of-ordinary/words-and/version-2/of_the_same"), (8, f"token={key}"), (9, key)]
    want = {1: aws, 2: key, 3: key, 4: key, 5: key + "==", 6: dashed, 7: None, 8: f"token={key}", 9: key}
    got = {r.doc_id: [r.text[x.start : x.end] for x in r.spans] for r in s.scan(docs(rows)).collect()}
    assert len(got[4]) == 1 and key in got.pop(4)[0] and want.pop(4)  # the words between its slashes are part of the piece
    assert got == {k: [v] if v else [] for k, v in want.items()}
    assert all(key not in r.text and aws not in r.text and dashed not in r.text for r in s.scan(docs(rows), redact=True).collect())
