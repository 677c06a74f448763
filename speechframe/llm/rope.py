r"""Fill-in-middle on ropes: a text is a tree whose leaves cache what they hold.

Units are words with the blanks before them (and blanks at the end).  A leaf
holds up to LEAF units and caches their number and the number of code points;
inner nodes add their children's.  A text is split at two unit ranks by walking
down the tree, and the three subtrees are concatenated in another order between
sentinels; no text is copied but the two leaves that are cut and the final join.
`restore` goes the other way: sentinels stand once each in a transformed text
(texts that hold one stay plain, and a sentinel's brackets can't be made across
a border), so the tree is split at their code-point ranks, the sentinel's
subtrees fall away and the parts are joined in order.

Whole texts, one at a time; trees are made and dropped inside a task and rows
stay where they are, so no group or key is gathered.

Defined results: a null text is empty; an empty text and a text with a sentinel
stay plain; the draw comes from sha256 of "seed:doc_id", where a null id is
the word null, so rows that share an id share their draw; repeated rows
repeat; extra columns pass through; an empty table gives no row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

LEAF = 64
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
UNITS, POINTS = "units", "points"


@lru_cache(maxsize=2 * LEAF)
def run_of(least: int, most: int) -> re.Pattern:
    return re.compile(f"(?:{UNIT}){{{least},{most}}}")


ONE, FULL = re.compile(UNIT), run_of(1, LEAF)


class Rope:
    """A leaf (text) or a pair of ropes; None is the empty rope."""

    __slots__ = ("text", "left", "right", "units", "points")

    def __init__(self, text: str | None, units: int, points: int, left: Rope | None = None, right: Rope | None = None):
        self.text, self.units, self.points, self.left, self.right = text, units, points, left, right


def leaf(text: str, units: int | None = None) -> Rope | None:
    return Rope(text, sum(1 for _ in ONE.finditer(text)) if units is None else units, len(text)) if text else None


def concat(*parts: Rope | None) -> Rope | None:
    out = None
    for p in parts:
        out = p if out is None else out if p is None else Rope(None, out.units + p.units, out.points + p.points, out, p)
    return out


def build(text: str) -> Rope | None:
    """Leaves of LEAF units, the last as it comes, paired level by level."""
    level = []
    for m in FULL.finditer(text):
        level.append(leaf(m.group(), LEAF if m.end() < len(text) else None))
    while len(level) > 1:
        level = [concat(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else None


def split(rope: Rope | None, rank: int, by: str = UNITS) -> tuple[Rope | None, Rope | None]:
    """The first ``rank`` units (or code points) and the rest."""
    left, right = [], []
    while rope is not None:
        if rank <= 0:
            right.append(rope)
            break
        if rank >= getattr(rope, by):
            left.append(rope)
            break
        if rope.text is not None:
            at = run_of(rank, rank).match(rope.text).end() if by == UNITS else rank
            left.append(leaf(rope.text[:at], rank if by == UNITS else None))
            right.append(leaf(rope.text[at:], rope.units - rank if by == UNITS else None))
            break
        size = getattr(rope.left, by)
        if rank < size:
            right.append(rope.right)
            rope = rope.left
        else:
            left.append(rope.left)
            rope, rank = rope.right, rank - size
    return concat(*left), concat(*reversed(right))


def flat(rope: Rope | None) -> str:
    out, todo = [], [rope] if rope else []
    while todo:
        r = todo.pop()
        if r.text is not None:
            out.append(r.text)
        else:
            todo += (r.right, r.left)
    return "".join(out)


def rearranged(text: str, draw: tuple[int, int, int, int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text under its four draws."""
    rope = build(text)
    n = rope.units if rope else 0
    if rope is None or draw[2] % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    low, high = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    head, suffix = split(rope, high)
    prefix, middle = split(head, low)
    p, s, m = (leaf(x) for x in SENTINELS)
    form = "spm" if draw[3] % 100 < spm else "psm"
    out = concat(s, suffix, p, prefix, m, middle) if form == "spm" else concat(p, prefix, s, suffix, m, middle)
    return n, form, prefix.points if prefix else 0, middle.points if middle else 0, flat(out)


def restored(output: str, form: str) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    rest, parts = build(output), {}
    for mark in reversed(order):
        rest, part = split(rest, output.index(mark), POINTS)
        parts[mark] = split(part, len(mark), POINTS)[1]
    return flat(concat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


def _with(df: DataFrame, fields: list[tuple[str, T.DataType]], make, inputs: list[str]) -> DataFrame:
    """df with columns made from rows of the named input columns; the inputs whose names begin with __ are left out."""
    clash = {f.lower() for f, _ in fields}
    keep = [f for f in df.schema if f.name not in inputs or not f.name.startswith("__")]
    keep = [f for f in keep if f.name.lower() not in clash]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in fields)])

    def task():
        def run(batch: pa.RecordBatch) -> list:
            made = [make(*row) for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs))]
            return [batch.column(batch.schema.get_field_index(f.name)) for f in keep] + [list(c) for c in (zip(*made) if made else [()] * len(fields))]

        return run

    return map_rows(df, schema, task, step=256)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs (doc_id, text) with n (units), form, prefix_chars, middle_chars and output. ``rate`` percent are transformed, ``spm`` percent of them suffix first. Columns of these names are replaced."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    drawn = docs.withColumn("__draw", digest)

    def make(text: str | None, h: str) -> tuple:
        return rearranged(text or "", tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8)), rate, spm)

    return _with(drawn, [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())], make, ["text", "__draw"])


def restore(df: DataFrame) -> DataFrame:
    """df (output, form) with ``restored``, the text before the transformation."""
    return _with(df, [("restored", T.StringType())], lambda output, form: (restored(output, form),), ["output", "form"])


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS h FROM d),
    c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p"""
