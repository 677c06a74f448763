"""Glossaries and keyword routing from rule tables of any size: one automaton over all rules per task.

A glossary applies its rules in order, each on what the ones before left.  The
automaton finds which rules a text can match at all; only those are applied, and
after each the neighbourhood of what it put in is looked through again for later
rules that match now.  So a text costs one pass plus the rules that change it,
not a pass a rule.  Rules for single words act on each word of a text by itself,
so a stretch of them is one look-up a word, however many of them change a text.

Rules travel to the tasks in blocks of at most BLOCK_BYTES, as counted on the way;
a larger table is applied block after block, in order, which is the same.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 32 << 20
#: Words whose outcome a task remembers, and stretches of rules of one kind that are applied one after the other.
KNOWN_WORDS, STRETCHES = 1 << 18, 16
WORD = re.compile(r"(\w+)")
#: Letters that a pattern matches in any case beyond their simple lower case. Fixed values.
ALSO = {"İ": "i", "ı": "i", "ﬅ": "ﬆ"}


def nfc(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "")


def one_case(c: str) -> str:
    """One letter for all that match each other in any case; always one character."""
    low = ALSO.get(c) or (c.lower() if len(c.lower()) == 1 else c)
    return ALSO.get(low) or (low.casefold() if len(low.casefold()) == 1 else low)


class Cases(dict):
    """`one_case` by code point, worked out as letters are met."""

    def __missing__(self, point: int) -> str:
        self[point] = c = one_case(chr(point))
        return c


CASES = Cases()


def key_of(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(CASES)


@lru_cache(maxsize=4096)
def pattern(wrong: str) -> re.Pattern:
    """Whole words where an edge is alphanumeric, in any case."""
    return re.compile(("\\b" if wrong[0].isalnum() else "") + re.escape(wrong) + ("\\b" if wrong[-1].isalnum() else ""), re.IGNORECASE)


def automaton(keys: dict[str, list[int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, numbers in keys.items():
        a.add_word(k, (len(k), numbers))
    if keys:
        a.make_automaton()
    return a


def single(rule: tuple[str, str]) -> bool:
    """Whether a rule matches whole words only: its edges are alphanumeric and no word ends inside."""
    wrong = rule[0]
    return wrong[0].isalnum() and wrong[-1].isalnum() and WORD.fullmatch(wrong) is not None


class Words(dict):
    """Ordered rules (wrong, right) for single words: what they make of a word, worked out as words are met."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules, self.numbers = rules, {}
        for i, (w, _) in enumerate(rules):
            self.numbers.setdefault(key_of(w), []).append(i)

    def rule(self, word: str, after: int) -> int | None:
        """The first rule beyond ``after`` for a word."""
        for i in self.numbers.get(key_of(word), ()):
            wrong = self.rules[i][0]
            if i > after and (word.isascii() and wrong.isascii() or pattern(wrong).fullmatch(word)):
                return i
        return None

    def __missing__(self, word: str) -> str:
        made, todo = [], [(word, -1)]
        while todo:
            x, after = todo.pop()
            i = None if after is None else self.rule(x, after)
            if i is None:
                made.append(x)
            else:  # what is put in stands between signs that belong to no word; its own words meet later rules only
                parts = WORD.split(self.rules[i][1])
                todo += reversed([(part, i if k % 2 else None) for k, part in enumerate(parts)])
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = out = "".join(made)
        return out

    def apply(self, text: str) -> str:
        parts = WORD.split(text)
        parts[1::2] = map(self.__getitem__, parts[1::2])
        return "".join(parts)


class Glossary:
    """Ordered rules (wrong, right): stretches of rules for single words and of others, in order; all of them as others if they alternate too often."""

    def __init__(self, rules: list[tuple[str, str]]):
        rules = [(nfc(w), nfc(r)) for w, r in rules if w]
        runs = [(Words if one else Phrases, list(g)) for one, g in groupby(rules, single)]
        self.steps = [make(g) for make, g in (runs if len(runs) <= STRETCHES else [(Phrases, rules)])]

    def apply(self, text: str | None) -> str:
        text = nfc(text)
        for step in self.steps:
            text = step.apply(text)
        return text


class Phrases:
    """Ordered rules (wrong, right) of any kind."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        keys: dict[str, list[int]] = {}
        for i, (w, _) in enumerate(self.rules):
            keys.setdefault(key_of(w), []).append(i)
        self.find, self.widest = automaton(keys), max(map(len, keys), default=0)

    def seen(self, text: str) -> Iterator[int]:
        if self.widest:
            for _, (_, numbers) in self.find.iter(key_of(text)):
                yield from numbers

    def apply(self, text: str) -> str:
        todo = sorted(set(self.seen(text)))
        known = set(todo)
        while todo:
            i = heapq.heappop(todo)
            wrong, right = self.rules[i]
            made, at, spots, size = [], 0, [], 0
            for m in pattern(wrong).finditer(text):
                made += [text[at : m.start()], right]
                size += m.start() - at + len(right)
                spots.append(size)  # where what was put in ends
                at = m.end()
            if not spots:
                continue
            text = "".join([*made, text[at:]])
            if len(known) < len(self.rules):  # all neighbourhoods in one scan; what it finds across their borders is tried in vain
                near = "\0".join([text[max(0, end - len(right) - self.widest) : end + self.widest] for end in spots])
                for k in set(self.seen(near)) - known:
                    if k > i:
                        known.add(k)
                        heapq.heappush(todo, k)
        return text


def blocks(rules: DataFrame, columns: list[str], order: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The rules in order, a bounded block at a time."""
    some, size = [], 0
    for r in rules.select(order, *columns).orderBy(order).toLocalIterator(prefetchPartitions=False):
        row = tuple(r)[1:]
        n = sum(4 * len(x) if isinstance(x, str) else 8 for x in row) + 64
        if some and size + n > most:
            yield some
            some, size = [], 0
        some.append(row)
        size += n
    if some:
        yield some


def glossary(df: DataFrame, column: str, rules: DataFrame, order: str = "ord", most: int = BLOCK_BYTES) -> DataFrame:
    """df with the rules (ord, wrong, right) applied to a column, in NFC: literal, whole words only where an edge is alphanumeric, in any case. A null text is empty."""
    out = df
    some = False
    for block in blocks(rules, ["wrong", "right"], order, most):
        some = True
        out = _mapped(out, column, T.StringType(), Glossary, block, "apply")
    return out if some else _mapped(out, column, T.StringType(), Glossary, [], "apply")


def _mapped(df: DataFrame, column: str, kind: T.DataType, make, block: list[tuple], method: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = getattr(make(shared.value), method)
        for b in batches:
            yield b.map(made)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(column, F.pandas_udf(run, kind)(F.col(column)))


class Keywords:
    """Keywords of buckets: (bucket, keyword), folded."""

    def __init__(self, rules: list[tuple[int, str]]):
        keys: dict[str, list[int]] = {}
        for bucket, word in rules:
            if word and bucket not in keys.setdefault(word, []):
                keys[word].append(bucket)
        self.find, self.some = automaton(keys), bool(keys)

    def hits(self, text: str | None) -> list[int]:
        """The buckets of every keyword that is there as a whole word, once a keyword."""
        found: dict[str, list[int]] = {}
        if self.some and text:
            for last, (size, numbers) in self.find.iter(text):
                first = last - size + 1
                if not (first and _word(text[first - 1])) and not (last + 1 < len(text) and _word(text[last + 1])):
                    found[text[first : last + 1]] = numbers
        return [n for numbers in found.values() for n in numbers]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def routed(df: DataFrame, column: str, rules: DataFrame, default: str, out: str = "bucket", most: int = BLOCK_BYTES) -> DataFrame:
    """df with the bucket of each text from keyword rules (ord of the bucket, bucket, keyword): the most keywords present as whole words, case and accents aside; ties to the first bucket, none to the default."""
    from ..functions.text import folded

    rules = rules.select(F.col("ord").cast("long").alias("ord"), "bucket", folded(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct()
    names = rules.groupBy("ord").agg(F.min("bucket").alias("__name"))
    scored = df.withColumn("__text", folded(F.col(column))).withColumn("__hits", F.array().cast("array<long>"))
    for block in blocks(rules, ["ord", "keyword"], "ord", most):
        got = _mapped(scored.withColumn("__more", F.col("__text")), "__more", T.ArrayType(T.LongType()), Keywords, block, "hits")
        scored = got.withColumn("__hits", F.concat("__hits", "__more")).drop("__more")
    counts = F.transform(F.array_distinct("__hits"), lambda b: F.struct(F.size(F.filter("__hits", lambda x: x == b)).alias("s"), (-b).alias("o")))
    best = scored.withColumn("__best", -F.array_max(counts)["o"]).drop("__text", "__hits")
    return best.join(names.withColumnRenamed("ord", "__best"), "__best", "left").withColumn(out, F.coalesce("__name", F.lit(default))).drop("__best", "__name")
