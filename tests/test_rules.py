"""Rule tables against rules applied one after the other."""

import random
import re
import unicodedata

import pytest

from speechframe.operators import rules

LETTERS = ["a", "b", "ab", "Ab", "é", "é", " ", ".", "-", "C++", "ſ", "K", "İ", "ı", "i", "_", "1", "ß", "Σ", "ς"]


def one_by_one(text, given):
    text = unicodedata.normalize("NFC", text or "")
    for wrong, right in given:
        if wrong:
            wrong, right = unicodedata.normalize("NFC", wrong), unicodedata.normalize("NFC", right or "")
            p = ("\\b" if wrong[0].isalnum() else "") + re.escape(wrong) + ("\\b" if wrong[-1].isalnum() else "")
            text = re.sub(p, lambda m: right, text, flags=re.IGNORECASE)  # noqa: B023
    return text


def test_like_one_rule_after_the_other():
    r = random.Random(4)
    word = lambda n: "".join(r.choices(LETTERS, k=r.randrange(1, n)))
    for _ in range(4000):
        given = [(word(4) if r.random() < 0.95 else "", r.choice([word(4), "", "\\1$1", None])) for _ in range(r.randrange(8))]
        text = r.choice([None, "", word(30), " ".join(w for w, _ in given)])
        assert rules.Glossary([(w, x) for w, x in given]).apply(text) == one_by_one(text, given), (given, text)


def test_rules_feed_later_ones_only():
    assert rules.Glossary([("a", "b"), ("b", "c"), ("c", "a")]).apply("a b c") == "a a a"
    assert rules.Glossary([("big apple", "nyc"), ("new", "big"), ("big apple", "NYC")]).apply("new apple") == "NYC"


@pytest.mark.parametrize("most", [1, 400, 1 << 20])
def test_tables_in_blocks(spark, most):
    """Ten thousand rules, some of which feed later ones; extra columns and nulls stay."""
    n = 10_000 if most > 400 else 12
    given = spark.createDataFrame([(k, f"w{k}", f"w{k + 1}" if k % 5 else "end") for k in range(n)], "ord long, wrong string, right string").repartition(3)
    df = spark.createDataFrame([(1, "W1 x w10", "p"), (2, None, None), (3, "", "q"), (4, "é w0w w3.", "r")], "id long, text string, wrong string")
    got = {r.id: (r.text, r.wrong) for r in rules.glossary(df, "text", given, most=most).collect()}
    assert got == {1: ("end x end", "p"), 2: ("", None), 3: ("", "q"), 4: ("é w0w end.", "r")}


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id long, text string")
    assert sorted(map(tuple, rules.glossary(df, "text", spark.createDataFrame([], "ord int, wrong string, right string")).collect())) == [(1, "é"), (2, "")]


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_routing(spark, most):
    given = spark.createDataFrame([(0, "work", "Réunion"), (0, "work", "call back"), (1, "home", "pain"), (1, "home", "lait"), (2, "trips", "call"), (2, "trips", "pain"), (1, "home", ""), (1, "home", "PAIN"), (1, "home", None)], "ord int, bucket string, keyword string")
    texts = ["la REUNION", "pain, lait", "pain", "callback", "call back the call", "", None, "lait_pain", "lait réunion"]
    got = {r.text: r.bucket for r in rules.routed(spark.createDataFrame([(t,) for t in texts], "text string"), "text", given, "inbox", most=most).collect()}
    assert got == dict(zip(texts, ["work", "home", "home", "inbox", "work", "inbox", "inbox", "inbox", "work"]))


def test_a_long_text_is_not_scanned_once_a_rule(monkeypatch):
    """Rules for single words cost a look-up a word, however many of them change the text; chains and growing words included."""
    given = [(f"w{k}", f"W{k} x{k}") for k in range(3000)] + [(f"x{k}", f"x{k + 1}") for k in range(3000)]
    made = rules.Glossary(given)

    def scanned(wrong):
        raise AssertionError(f"a scan for {wrong}")

    monkeypatch.setattr(rules, "pattern", scanned)
    assert made.apply(" ".join(f"w{k}." for k in range(3000))) == " ".join(f"W{k} x3000." for k in range(3000))


def test_stretches_of_words_and_phrases():
    r = random.Random(5)
    word = lambda: r.choice(["a", "b", "ab", "é", "K", "k", "ſ", "s", "a_b", "1"])
    for _ in range(2000):
        given = [(word() + r.choice(["", "", "", " " + word(), "."]), r.choice([word(), f"{word()} {word()}", "", "."])) for _ in range(r.randrange(40))]
        text = "".join(word() + r.choice([" ", ". ", "-", ""]) for _ in range(20))
        assert rules.Glossary(given).apply(text) == one_by_one(text, given), (given, text)
