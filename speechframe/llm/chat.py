"""Preference formatting of conversations, in DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their turns are lined up by
position; the turns before the first position at which they differ (in role or
text) are the common prefix and are rendered once, as the prompt.  What is left
of each side is its completion, with a loss mask: rendered turns of the
``trained`` role count, all others don't.

The comparison shuffles turns by (pair, position) and pre-aggregates the first
difference per pair, so that no task needs a whole pair to find it; only the
rendered strings of a pair meet, in the row that holds them.

Defined results: positions are ranks of ``turn``; rows that share conversation
and turn are ordered by role and text, all kept; a null turn comes first; a null
role renders as "unknown" and a null text as empty; rows without a pair are no
part of any; a pair with one side missing has an empty prompt, an empty
completion for that side and complete = false; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preference_examples(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Examples of ``turns`` (pair_id, chosen boolean, turn, role, text).

    Returns per pair: pair_id, prompt, prompt_turns, chosen, chosen_mask,
    rejected, rejected_mask, complete.  A mask lists "length:flag" per turn of the
    completion, in characters, flag 1 where the loss counts.
    """
    rows = turns.where("pair_id is not null and chosen is not null").select(
        "pair_id", "chosen", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("pair_id", "chosen").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(w))
    # One row a position, with what either side has there.
    side = lambda chosen: F.max(F.when(F.col("chosen") == chosen, F.struct("role", "text")))
    lined = rows.groupBy("pair_id", "pos").agg(side(True).alias("c"), side(False).alias("r"))
    differs = lined.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("pos").alias("first"))
    marked = lined.join(differs, "pair_id", "left").withColumn("common", F.col("first").isNull() | (F.col("pos") < F.col("first")))

    def parts(s: str, common: bool) -> Column:
        keep = F.col(s).isNotNull() & (F.col("common") == common)
        text = rendered(F.col(f"{s}.role"), F.col(f"{s}.text"))
        return F.sort_array(F.collect_list(F.when(keep, F.struct("pos", text.alias("t"), (F.col(f"{s}.role") == trained).cast("int").alias("f")))))

    packed = marked.groupBy("pair_id").agg(
        parts("c", True).alias("p"), parts("c", False).alias("c"), parts("r", False).alias("r"), F.max(F.col("c").isNotNull()).alias("has_c"), F.max(F.col("r").isNotNull()).alias("has_r"))
    joined = lambda c: F.array_join(F.col(f"{c}.t"), "")
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.char_length(x.t).cast("string"), x.f.cast("string"))), ",")
    return packed.select(
        "pair_id", joined("p").alias("prompt"), F.size("p").alias("prompt_turns"), joined("c").alias("chosen"), mask("c").alias("chosen_mask"),
        joined("r").alias("rejected"), mask("r").alias("rejected_mask"), (F.col("has_c") & F.col("has_r")).alias("complete"))


ORACLE_SQL = """
    WITH t AS (SELECT (conv_id - abs(conv_id % 2)) // 2 AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
    l AS (SELECT pair_id, pos, max(CASE WHEN chosen THEN role END) AS cr, max(CASE WHEN chosen THEN text END) AS ct,
                 max(CASE WHEN NOT chosen THEN role END) AS rr, max(CASE WHEN NOT chosen THEN text END) AS rt FROM n GROUP BY ALL),
    m AS (SELECT *, coalesce(min(CASE WHEN cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt THEN pos END) OVER (PARTITION BY pair_id), 1000000000) AS first FROM l)
    SELECT pair_id,
           coalesce(string_agg('<|' || cr || '|>' || chr(10) || ct || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (WHERE pos < first), '') AS prompt,
           CAST(count(*) FILTER (WHERE pos < first) AS INTEGER) AS prompt_turns,
           coalesce(string_agg('<|' || cr || '|>' || chr(10) || ct || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (WHERE pos >= first AND cr IS NOT NULL), '') AS chosen,
           coalesce(string_agg(CAST(length(cr) + length(ct) + 13 AS VARCHAR) || ':' || CASE WHEN cr = 'assistant' THEN '1' ELSE '0' END, ',' ORDER BY pos) FILTER (WHERE pos >= first AND cr IS NOT NULL), '') AS chosen_mask,
           coalesce(string_agg('<|' || rr || '|>' || chr(10) || rt || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (WHERE pos >= first AND rr IS NOT NULL), '') AS rejected,
           coalesce(string_agg(CAST(length(rr) + length(rt) + 13 AS VARCHAR) || ':' || CASE WHEN rr = 'assistant' THEN '1' ELSE '0' END, ',' ORDER BY pos) FILTER (WHERE pos >= first AND rr IS NOT NULL), '') AS rejected_mask,
           bool_or(cr IS NOT NULL) AND bool_or(rr IS NOT NULL) AS complete
    FROM m GROUP BY pair_id"""
