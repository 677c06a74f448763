"""Language identification by word-first backoff.

A word seen in training scores by its log frequency in every language.  An
unseen word is covered from the left by character n-grams, longest first: at
each place the longest known n-gram (4 down to 1) scores by its log frequency
and the cover moves past it; a character that no language knows is skipped.
A text's language is the one with the highest sum over its words; the score is
its share in the softmax of the mean log likelihoods, tempered by length.

Fitting counts words and n-grams over the training rows in DataFrame
aggregations.  The rows may be a sample: about ``SAMPLE_ROWS`` of the training
rows, chosen by a hash of their text: that many different texts at most, and all
copies of each, which count words before they are shuffled; so the model is
bounded whatever the corpus. Languages share the sample evenly, rare ones are taken whole and each
keeps at least the rows of its smallest hash.  The words and n-grams kept are
all of them that these rows hold at least ``MIN_COUNT`` times.

Defined results: a null text or one without letters is "und" with score 0; with
no training rows every text is "und"; rows with a null language or text teach
nothing; repeated rows count each time; ties go to the language first in order.
"""

from __future__ import annotations

import math
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, schema

SAMPLE_ROWS, MIN_COUNT, ORDER = 20_000, 2, 4
#: Values of a text's hash that choose the sample.
HASHES = 1 << 40
#: Words remembered by a task (the later half goes when full).
MEMORY = 60_000
#: Between words, in fitting. In scoring, runs of what Python calls alphabetic, which is the same class; the pattern also lets other numerals through, so its finds are looked at again.
WORDS = r"[^\p{L}]+"
ALNUM = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters of a text, in lower case."""
    found = ALNUM.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


class Model:
    """Languages, and per known word and n-gram a row of log frequencies, as compact arrays (dictionaries are made where texts are scored)."""

    def __init__(self, languages: list[str], words: pa.Array, word_rows: np.ndarray, grams: pa.Array, gram_rows: np.ndarray):
        self.languages, self.words, self.grams = languages, words, grams
        self.table = np.concatenate([word_rows, gram_rows]).astype(np.float32).reshape(-1, max(1, len(languages)))

    def index(self) -> tuple[dict[str, int], dict[str, int]]:
        """Places of words and of n-grams in the table."""
        return {w: i for i, w in enumerate(self.words.to_pylist())}, {g: i for i, g in enumerate(self.grams.to_pylist(), len(self.words))}


def log_rows(found: pa.Table, languages: list[str], totals: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of (lang, word, n) and their rows of smoothed log frequencies; totals: per row of found and language, or per language."""
    coded = found["word"].combine_chunks().dictionary_encode()
    codes, n = coded.indices.to_numpy(zero_copy_only=False), found["n"].to_numpy()
    lang = pc.index_in(found["lang"], value_set=pa.array(languages, pa.string())).to_numpy()
    rows = np.full((len(coded.dictionary), len(languages)), 0.5)
    np.add.at(rows, (codes, lang), n)
    return coded.dictionary, np.log(rows) - np.log(totals + 1)


def even_shares(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """Rows each language gives to a sample: as many as another, or all it has; at least one."""
    out, left = {}, rows
    for i, (k, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[k] = max(1, min(n, left // (len(sizes) - i)))
        left -= out[k]
    return out


def by_language(values: dict[str, int]) -> Column:
    """The language's value; null where it has none."""
    return F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in values.items()]) if values else F.lit(None).cast("long")


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, min_count: int = MIN_COUNT) -> Model:
    """A model of ``rows`` (text, lang). What reaches the driver is the vocabulary of about ``sample_rows`` texts."""
    known = rows.where("text is not null and lang is not null").select("text", "lang")
    hashed = F.pmod(F.xxhash64("text"), F.lit(HASHES))
    sizes = {r.lang: (r.n, r.least) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min(hashed).alias("least")).collect()}
    if sum(n for n, _ in sizes.values()) > sample_rows:  # the smallest hashes of every language, found by their share: a bounded number whatever the corpus
        shares = even_shares({k: n for k, (n, _) in sizes.items()}, sample_rows)
        known = known.where(hashed < by_language({k: max(HASHES * shares[k] // n, least + 1) for k, (n, least) in sizes.items()}))
    words = known.select("lang", F.explode(F.split(F.lower("text"), WORDS)).alias("word")).where("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    try:
        gram = F.transform(F.sequence(F.lit(1), F.char_length("p") - F.col("k") + 1), lambda i: F.substring(F.col("p"), i, F.col("k")))
        padded = counts.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("p")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ORDER)))).where(F.char_length("p") >= F.col("k"))
        grams = padded.select("lang", "n", F.explode(gram).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()

        word_rows, gram_rows = (df.where(F.col("n") >= min_count).select("lang", "word", "n").toArrow() for df in (counts, grams))
        sums = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        grams.unpersist()
    finally:
        counts.unpersist()
    languages = sorted(sums)
    if not languages:
        return Model([], pa.array([], pa.string()), np.empty((0, 1)), pa.array([], pa.string()), np.empty((0, 1)))
    known_words = log_rows(word_rows, languages, np.array([sums[k] for k in languages], float))
    parts = []
    for k in range(1, ORDER + 1):  # frequencies are those among n-grams of one length
        part = gram_rows.filter(pc.equal(pc.utf8_length(gram_rows["word"]), k))
        lang = pc.index_in(part["lang"], value_set=pa.array(languages, pa.string())).to_numpy()
        parts.append(log_rows(part, languages, np.bincount(lang, part["n"].to_numpy(), len(languages))))
    return Model(languages, *known_words, pa.concat_arrays([g for g, _ in parts]), np.concatenate([r for _, r in parts]))


class Scorer:
    """Scores texts; unseen words are worked out once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.n = len(model.languages)
        self.words, self.grams = model.index()
        self.table = np.zeros((1 << 16, max(1, self.n)), np.float32)
        self.index: dict[str, int] = {}  # of words met, by their row in this object's table

    def places(self, word: str) -> list[int]:
        """Rows of the model that make up a word: its own, or those of the n-grams that cover it."""
        i = self.words.get(word)
        if i is not None:
            return [i]
        padded, at, out = f" {word} ", 0, []
        get, end = self.grams.get, len(word) + 2
        while at < end:
            for k in range(min(ORDER, end - at), 0, -1):
                g = get(padded[at : at + k])
                if g is not None:
                    out.append(g)
                    at += k
                    break
            else:
                at += 1
        return out

    def vector(self, word: str) -> np.ndarray:
        return self.model.table[self.places(word)].sum(0)

    def codes(self, words: list[str]) -> np.ndarray:
        index = self.index
        new = list(set(words).difference(index))
        if new:
            parts = [self.places(w) for w in new]
            ends = np.cumsum([len(p) for p in parts])
            upto = np.concatenate([np.zeros((1, self.table.shape[1])), np.cumsum(self.model.table[np.fromiter(chain.from_iterable(parts), np.int64, int(ends[-1]))], axis=0, dtype=np.float64)])
            first = len(index)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
            index.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(index.__getitem__, words), np.int32, len(words))

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not self.n or not words:
            return "und", 0.0
        if len(self.index) > MEMORY:
            self.index = dict(islice(self.index.items(), MEMORY // 2))  # those met first are the frequent ones
        used = np.bincount(self.codes(words), minlength=len(self.index))
        at = np.flatnonzero(used)
        sums = used[at].astype(np.float64) @ self.table[at].astype(np.float64)
        best = int(np.argmax(sums))
        temper = 1.0 / math.sqrt(len(words))
        p = np.exp((sums - sums[best]) * temper)
        return self.model.languages[best], float(1.0 / p.sum())


def predict(df: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the predicted language and its score to every row of df (text)."""
    kept = [c for c in df.columns if c not in (lang_col, score_col)]
    kind = T.StructType([df.schema[c] for c in kept] + list(schema(f"{lang_col} string,{score_col} double")))
    shared = df.sparkSession.sparkContext.broadcast(model)  # the vocabulary of a bounded number of texts

    def make():
        scorer = Scorer(shared.value)

        def f(batch: pa.RecordBatch) -> list:
            got = [scorer.score(x) for x in batch.column("text").to_pylist()]
            return [batch.column(c) for c in kept] + [[x[0] for x in got], [x[1] for x in got]]

        return f

    return map_rows(df, kind, make)


def held_out(modulus: int, remainder: int):
    """crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
