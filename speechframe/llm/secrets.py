"""Secret scanning: fixed patterns, and a battery of randomness tests.

The base patterns find assignments, access keys and long hexadecimal runs.  The
battery looks at every run of 16 or more characters of the base-64 alphabets
that holds a digit and a letter.  Its encoding is inferred (the smallest of hex,
base 32, base 36, base 62 and base 64 that holds all its characters) and three
tests ask whether it looks uniform over that alphabet: chi-squared counts (with
simulated tails where the run is short), runs about the median, and serial
correlation, combined by Bonferroni's rule.

Two false-discovery controls follow, each by the Benjamini-Hochberg rule at
``FDR`` among the runs of a length class (powers of two) of all documents.  The
first takes the battery's p-values and tells the runs that aren't uniform.  The
second asks of the others whether ordinary text could have made them: the
likelihood under the uniform alphabet against that of ordinary text, in which
characters stay within their class and letters follow each other as they do in
the documents, bounds a p-value by Markov's inequality.  So short runs have to
be more telling than long ones.  A run that no single alphabet
holds (``name=token``, a path with dashes) is cut at "="; of a part that still
fits none, the pieces between "_" and "-", those between "/" and "+" and those
between all four are tested, at a third of their evidence each, and the most
telling that don't overlap stand.  A run that an alphabet holds is tested whole.  What it learns are the
counts of 676 letter pairs and a histogram of bounded size, gathered in two
passes over all documents.

Spans are in code points, end exclusive.  Battery spans that meet a base span
aren't added.

Defined results: a null or empty text has no spans; repeated documents count
each time in the histogram; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, schema

#: Kinds in the order in which equal starts are listed. Fixed values.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
HINTS = ("passw", "secret", "token", "api")
LEAST, FDR, BINS = 16, 0.01, 256
#: Bins of the battery's p-values to a halving; draws and longest run of the simulated chi-squared tails; weight of the documents' letter pairs against equal ones.
FINE, DRAWS, SIMULATED, LEARNED = 4, 8192, 64, 0.9
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by name, smallest alphabet first. Fixed values.
ALPHABETS = {
    "hex": DIGIT + "abcdef", "HEX": DIGIT + "ABCDEF", "base32": UPPER + "234567", "base36": DIGIT + LOWER, "BASE36": DIGIT + UPPER,
    "base62": DIGIT + UPPER + LOWER, "base64": UPPER + LOWER + DIGIT + "+/", "base64url": UPPER + LOWER + DIGIT + "-_",
}
SETS = {k: (frozenset(v), {c: i for i, c in enumerate(v)}) for k, v in ALPHABETS.items()}
#: Parts of a run that no alphabet holds, and the ways to cut those that still fit none.
PARTS, PIECES = re.compile("[^=]+"), (re.compile("[^_-]+"), re.compile("[^/+]+"), re.compile("[^_/+-]+"))
#: Bits of evidence that the choice among the three ways costs at most.
CHOICE_BITS = 2
#: Among those ways, pieces in a bin of the battery beyond this one (p < 0.001) come last.
ODD = 40
DIGITS, LOWERS, UPPERS = frozenset(DIGIT), frozenset(LOWER), frozenset(UPPER)
#: Bits of ordinary text: a character in the class of the one before, one in another, a digit.
STAY, LEAVE, TEN = -math.log2(0.9), math.log2(30), math.log2(10)
#: Bytes of latin-1 that may be part of a run.
INSIDE = np.zeros(256, bool)
INSIDE[[ord(c) for c in DIGIT + UPPER + LOWER + "+/_=-"]] = True


def runs(text: str, least: int = LEAST) -> list[tuple[int, int]]:
    """Spans of maximal runs of the base-64 alphabets."""
    inside = INSIDE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=None)
def chi_tails(n: int, k: int) -> np.ndarray:
    """Sorted chi-squared statistics of DRAWS runs of n uniform letters of k: sums of squared counts (at most SIMULATED lengths for each alphabet's size)."""
    draws = np.random.default_rng(n * 1000 + k).integers(0, k, (DRAWS, n)) + np.arange(DRAWS)[:, None] * k
    return np.sort((np.bincount(draws.ravel(), minlength=DRAWS * k).reshape(DRAWS, k) ** 2).sum(1))


def chi_p(x: np.ndarray, k: int) -> float:
    """Of counts as uneven as x's: simulated, or Wilson and Hilferty's normal tail of a long run and beyond the draws."""
    n, d = len(x), k - 1
    squares = int((np.bincount(x, minlength=k) ** 2).sum())
    tail = normal_tail(((max(k / n * squares - n, 0.0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    if n > SIMULATED:
        return tail
    drawn = chi_tails(n, k)
    more = DRAWS - int(np.searchsorted(drawn, squares))
    return (more + 1) / (DRAWS + 1) if more else min(tail, 1 / (DRAWS + 1))


def uniform_p(x: np.ndarray, k: int) -> float:
    """Bonferroni's combination of the three tests that x is uniform over 0..k-1."""
    n = len(x)
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - x.mean()
    s = float((y * y).sum())
    p_serial = 2 * normal_tail(abs(float((y[1:] * y[:-1]).sum()) / s * math.sqrt(n) + 1 / math.sqrt(n))) if s else 0.0
    return min(1.0, 3 * min(chi_p(x, k), p_runs, p_serial))


class Ordinary:
    """Ordinary text: bits of a letter after another (26 x 26) and of a first one, from counts of letter pairs."""

    def __init__(self, pairs: np.ndarray | None = None):
        n = np.ones((26, 26)) if pairs is None else pairs + 1.0
        mixed = lambda p: (-np.log2(LEARNED * p + (1 - LEARNED) / 26)).tolist()
        self.after, self.first = mixed(n / n.sum(1, keepdims=True)), mixed(n.sum(0) / n.sum())

    def bits(self, token: str) -> float:
        """-log2 of the token's likelihood: nine times in ten a character stays in the class of the one before, else it is in one of the three others."""
        total, before, last = math.log2(4), None, 0
        for c in token:
            kind = 0 if c in DIGITS else 1 if c in LOWERS else 2 if c in UPPERS else 3
            if before is not None:
                total += STAY if kind == before else LEAVE
            if kind in (1, 2):
                i = ord(c) - (97 if kind == 1 else 65)
                total += self.after[last][i] if kind == before else self.first[i]
                last = i
            else:
                total += TEN if kind == 0 else 2.0
            before = kind
        return total


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """Counts of ASCII letter pairs, case aside, over all texts of docs (text): 676 numbers."""

    def make():
        def f(batch: pa.RecordBatch) -> list | None:
            raw = np.frombuffer("\n".join(t for t in batch.column(0).to_pylist() if t).encode().lower(), np.uint8) - np.uint8(97)
            a, b = raw[:-1], raw[1:]
            both = (a < 26) & (b < 26)
            n = np.bincount(a[both].astype(np.int32) * 26 + b[both], minlength=676)
            at = np.flatnonzero(n)
            return [at.astype(np.int32), n[at]] if len(at) else None

        return f

    out = np.zeros(676)
    for r in map_rows(docs.select("text"), schema("pair int,n long"), make).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(26, 26)


def encoding(body: str) -> str | None:
    """The smallest alphabet that holds all characters."""
    letters = frozenset(body)
    return next((k for k, (s, _) in SETS.items() if letters <= s), None)


def candidate(token: str, text: Ordinary) -> tuple[int, int, int] | None:
    """(length class, bin of the battery's p-value, bin of the evidence against ordinary text) of a run that is tested, else None."""
    body = token.rstrip("=")
    if len(body) < LEAST or not any(c in DIGITS for c in body) or not any(c.isalpha() for c in body):
        return None
    name = encoding(body)
    if name is None:
        return None
    place, k = SETS[name][1], len(ALPHABETS[name])
    p = uniform_p(np.array([place[c] for c in body]), k)
    bits = text.bits(body) - len(body) * math.log2(k)
    return int(math.log2(len(body))), min(BINS - 1, int(-FINE * math.log2(max(p, 1e-30)))), max(0, min(BINS - 1, int(bits)))


def candidates(text: str, a: int, b: int, model: Ordinary) -> list[tuple[int, int, int, int, int]]:
    """(start, end, length class, bin of uniformity, bin of evidence) of what is tested in a run: the run itself, or parts of one that no alphabet holds."""
    body = text[a:b].rstrip("=")
    if encoding(body) is not None:
        c = candidate(body, model)
        return [(a, b, *c)] if c else []
    out = []
    for m in PARTS.finditer(body):
        if encoding(m[0]) is not None:
            tried, loss = [m.span()], 0
        else:
            tried, loss = sorted({x.span() for p in PIECES for x in p.finditer(body, *m.span())}), CHOICE_BITS
        got = [(x, y, c[0], c[1], max(0, c[2] - loss)) for x, y in tried if y - x >= LEAST and (c := candidate(body[x:y], model)) is not None]
        taken: list[tuple[int, int, int, int, int]] = []
        for g in sorted(got, key=lambda g: (g[3] > ODD, -g[4], g[0] - g[1], g[0])):
            if all(g[1] <= t[0] or t[1] <= g[0] for t in taken):
                taken.append(g)
        out += [(a + x, b if y == len(body) else a + y, *rest) for x, y, *rest in sorted(taken)]  # padding goes with the last part
    return out


def base_spans(text: str, found: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns; access keys and hex runs lie within the runs found."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for a, b in found:
        if b - a >= 20 and "AKIA" in text[a:b]:
            out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        if b - a >= 24:
            out += [("hex", m.start(), m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def first_cut(bins: dict[int, int], level: float, to_p) -> int | None:
    """The least bin that is a discovery by the Benjamini-Hochberg rule; to_p: the largest p-value of a bin."""
    total, seen, cut = sum(bins.values()), 0, None
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        if to_p(b) <= level * seen / total:
            cut = b
    return cut


def thresholds(docs: DataFrame, model: Ordinary, fdr: float = FDR) -> dict[int, tuple[int, int]]:
    """By length class, over all tested runs of all documents: the least bin of the battery that isn't uniform, and the least bin of evidence that is a secret."""

    def make():
        def f(batch: pa.RecordBatch) -> list | None:
            count: dict[tuple[int, int, int], int] = {}
            for text in batch.column(0).to_pylist():
                for a, b in runs(text or ""):
                    for _, _, *c in candidates(text, a, b, model):
                        count[tuple(c)] = count.get(tuple(c), 0) + 1
            return [*([k[i] for k in count] for i in range(3)), list(count.values())] if count else None

        return f

    parts = map_rows(docs.select("text"), schema("size int,odd int,bin int,n long"), make)
    hist: dict[int, list[tuple[int, int, int]]] = {}
    for r in parts.groupBy("size", "odd", "bin").agg(F.sum("n").alias("n")).collect():  # at most 32 classes of BINS x BINS rows
        hist.setdefault(r.size, []).append((r.odd, r["bin"], r.n))
    cut = {}
    for size, rows in hist.items():
        sums = [Counter(), Counter()]
        for odd, _, n in rows:
            sums[0][odd] += n
        uneven = first_cut(sums[0], fdr, lambda b: 2.0 ** (-b / FINE))
        uneven = BINS if uneven is None else uneven
        for odd, b, n in rows:
            if odd < uneven:
                sums[1][b] += n
        least = first_cut(sums[1], fdr, lambda b: 2.0**-b)
        cut[size] = (uneven, BINS if least is None else least)
    return cut


def all_spans(text: str | None, cut: dict[int, tuple[int, int]], model: Ordinary) -> list[tuple[str, int, int]]:
    if not text:
        return []
    found = runs(text)
    spans = base_spans(text, found)
    base = list(spans)
    for a, b in found:
        for start, end, size, odd, n in candidates(text, a, b, model):
            uneven, least = cut.get(size, (0, BINS))
            if odd < uneven and n >= least and not any(x < end and start < y for _, x, y in base):
                spans.append(("random", start, end))
    return ordered(spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every group of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, fdr: float = FDR, redact: bool = False, out_col: str = "spans") -> DataFrame:
    """Adds ``out_col`` (array of kind, start, end) to every row of docs (text); with redact, also cuts them out of the text."""
    model = Ordinary(letter_pairs(docs))
    cut = thresholds(docs, model, fdr)
    kept = [c for c in docs.columns if c != out_col]
    kind = T.StructType([docs.schema[c] for c in kept] + list(schema(f"{out_col} spans")))

    def make():
        def f(batch: pa.RecordBatch) -> list:
            texts = batch.column("text").to_pylist()
            spans = [all_spans(t, cut, model) for t in texts]
            new = [redacted(t, s) if s else t for t, s in zip(texts, spans)] if redact else None
            return [new if redact and c == "text" else batch.column(c) for c in kept] + [[[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]]

        return f

    return map_rows(docs, kind, make)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and the joined spans of scanned documents (doc_id, spans)."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s.kind != "random")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(listed(ordered(base_spans(text, runs(text)))).encode() if text else b"").hexdigest()
