"""Rules that look at their own earlier output: one ordered pass over a meeting.

A meeting is a bounded group (hours of speech), so each is held whole in a
task; the rows are sorted by the order column, ties included.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What marks count for as ends of a speaker's turn, marks that can't start a block, words that tell how spaces are brought.
WEIGHTS = dict.fromkeys(".!?…", 2.0) | dict.fromkeys(",;:", 0.5)
HEAD_MARKS, TOLD_BY = "?!.;:…", 80


def fold(df: DataFrame, key: str, order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies f to every key's rows in order.

    Rows come sorted by key and order, and keys are cut from them in passing: a group of ``applyInPandas`` a key would cost
    milliseconds, however few rows it has. The number of tasks is that of shuffle partitions, as rows are small beside the work on them.
    """
    kind, n = df.schema[key].dataType, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = df.withColumns({key: F.coalesce(F.col(key), F.lit(0).cast(kind)), "__none": F.col(key).isNull()})

    def applied(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        out = f(rows.drop(columns="__none").reset_index(drop=True))
        out.insert(0, key, None if rows["__none"].iloc[0] else rows[key].iloc[0])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for b in batches:
            if b.empty:
                continue
            keys, none = b[key].to_numpy(), b["__none"].to_numpy()
            at = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (none[1:] != none[:-1])) + 1).tolist(), len(b)]
            done = []
            for lo, hi in zip(at, at[1:]):
                if held and (keys[lo], none[lo]) != last:
                    done.append(applied(held))
                    held = []
                last = (keys[lo], none[lo])
                held.append(b.iloc[lo:hi])
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield applied(held)

    return given.repartition(n, key).sortWithinPartitions("__none", key, *order).mapInPandas(run, schema)


def absorb_short(start: np.ndarray, end: np.ndarray, speaker: list, least: float = 1.0) -> list:
    """A short segment takes the speaker of its longer neighbour (the left of equals), which may itself have changed."""
    out, length = list(speaker), end - start
    for i in np.flatnonzero(length < least):
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(out)]
        if near:
            out[i] = out[max(near, key=lambda j: (length[j], -j))]
    return out


def median3(labels: list) -> list:
    return [labels[i - 1] if 0 < i < len(labels) - 1 and labels[i - 1] == labels[i + 1] else x for i, x in enumerate(labels)]


def postprocess(pdf: pd.DataFrame, least: float = 1.0, gap: float = 0.5) -> pd.DataFrame:
    """Short segments absorbed, single flips smoothed, near neighbours of one speaker joined."""
    labels = median3(absorb_short(pdf["start"].to_numpy(), pdf["end"].to_numpy(), pdf["speaker"].tolist(), least))
    rows: list[list] = []
    for s, e, x in zip(pdf["start"], pdf["end"], labels):
        if rows and rows[-1][2] == x and s - rows[-1][1] <= gap:
            rows[-1][1] = e
        else:
            rows.append([s, e, x])
    return pd.DataFrame(rows, columns=["start", "end", "speaker"]).assign(ord=range(len(rows)))[["ord", "start", "end", "speaker"]]


def break_scores(words: list[str], start: np.ndarray, end: np.ndarray, pause: float = 0.20) -> np.ndarray:
    """How good a place before each word is for a change of speaker: what the word before ends with, and a pause of at least ``pause`` s (by its length up to a second)."""
    marks = np.array([WEIGHTS.get(w.strip()[-1:], 0.0) for w in words[:-1]])
    gaps = np.asarray(start, float)[1:] - np.asarray(end, float)[:-1]
    return np.concatenate([[-1.0] * min(1, len(words)), marks + np.where(gaps >= pause, 1.0 + np.minimum(gaps, 1.0), 0.0)])


def snapped(labels: list, score: np.ndarray, reach: int = 2) -> list:
    """Changes of speaker moved by at most ``reach`` words to a strictly better break (the nearer of equals), left to right."""
    out, i, n = list(labels), 1, len(labels)
    while i < n:
        if out[i] == out[i - 1]:
            i += 1
            continue
        span = range(max(1, i - reach), min(n, i + reach + 1))
        best = min(span, key=lambda j: (-round(score[j], 9), abs(j - i), j))
        if best != i and score[best] > score[i] + 1e-9:
            lo, hi = min(i, best), max(i, best)
            out[lo:hi] = [out[i - 1] if best > i else out[i]] * (hi - lo)
            i = hi + 1
        else:
            i += 1
    return out


def head_and_body(text: str) -> tuple[str, str]:
    """The run of end marks that a text starts with, and what follows."""
    text = text.strip()
    body = text.lstrip(HEAD_MARKS)
    return text[: len(text) - len(body)], body.lstrip()


def loose_capital(text: str) -> tuple[str, str]:
    """A text without the lone capital that it ends with, and that capital ('' if none)."""
    text = text.rstrip()
    last, before = text[-1:], text[-2:-1]
    lone = ("A" <= last <= "Z" or "À" <= last <= "Ý") and (not before or before.isspace())
    return (text[:-1].rstrip(), last) if lone else (text, "")


def polished(texts: list[str]) -> list[str]:
    """Blocks put together from their parts: the marks at a block's head close the block before, unless that has nothing left; a lone capital at its end opens the block after, if that starts with an apostrophe. '' where nothing is left."""
    parts = [head_and_body(t) for t in texts]
    given: list[bool] = []  # whether a block's head goes to the one before
    for i, (head, _) in enumerate(parts):
        before = i and (parts[i - 1][1] or (parts[i - 1][0] and not given[-1]))
        given.append(bool(head and before))
    closed = [(body if give else text) + (parts[i + 1][0] if i + 1 < len(parts) and given[i + 1] else "") for i, (text, (_, body), give) in enumerate(zip(texts, parts, given))]
    out, carried = [], ""
    for i, text in enumerate(closed):
        text = carried + (text.lstrip() if carried else text)
        rest, capital = loose_capital(text)
        moves = bool(capital) and i + 1 < len(closed) and closed[i + 1].lstrip().startswith("'")
        out.append(rest if moves else text)
        carried = capital if moves else ""
    return out


def to_blocks(words: list[str], start, end, labels: list) -> pd.DataFrame:
    """Runs of a label with their text, edges polished, empty blocks gone. Words that bring their own spaces (told by the first of them) are put together as they are."""
    labels = np.asarray(labels, object)
    first = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]])) if len(labels) else np.empty(0, int)
    last = np.append(first[1:], len(labels)) - 1 if len(first) else first
    own = any(w[:1] == " " for w in words[:TOLD_BY])
    text = [("" if own else " ").join(words[a : b + 1] if own else [w.strip() for w in words[a : b + 1]]).strip() for a, b in zip(first, last)]
    runs = pd.DataFrame({"speaker": labels[first], "start": np.asarray(start)[first], "end": np.asarray(end)[last], "text": polished(text)})
    runs = runs[runs["text"].str.strip() != ""].reset_index(drop=True)
    return runs.assign(ord=range(len(runs)))[["ord", "speaker", "start", "end", "text"]]


BLOCKS = "ord long, speaker string, start double, end double, text string"


def labelled_to_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Words (word, start, end, speaker) to blocks: single flips, snapping, runs, polish."""
    words, start, end = pdf["word"].tolist(), pdf["start"].to_numpy(), pdf["end"].to_numpy()
    labels = median3(pdf["speaker"].tolist())
    return to_blocks(words, start, end, snapped(labels, break_scores(words, start, end)))


def continued(labels: list, share, start, end, pause: float = 0.25, least: float = 0.60) -> list:
    """A unit close to the one before whose vote isn't clear keeps that one's speaker, as decided."""
    out: list = []
    for i, x in enumerate(labels):
        out.append(out[-1] if out and x != out[-1] and start[i] - end[i - 1] < pause and share[i] < least else x)
    return out


def split_long(start, end, most: float = 6.0, tail: float = 0.05) -> list[tuple[float, float]]:
    """Regions of at most about ``most`` seconds, cut at ends of words."""
    out, at = [], start[0]
    for e in end:
        if e - at >= most:
            out.append((at, e))
            at = e
    if end[-1] - at > tail:
        out.append((at, end[-1]))
    return out


def window_cuts(level: np.ndarray, step: float = 0.1, target: float = 25.0, most: float = 40.0, search: float = 8.0, quiet: float = 0.012, overlap: float = 1.0, backwards: bool = True) -> list[tuple[int, int]]:
    """Windows (first frame, last frame + 1) of a recording: cut after a quiet frame looked for backwards over the last
    seconds (or forwards from the target), by force at ``most``; an unforced cut repeats ``overlap`` seconds."""
    n, at, out = len(level), 0, []
    t, m, s, o = (round(x / step) for x in (target, most, search, overlap))
    have = t
    while n - at >= t:
        have = min(have, n - at)
        if backwards:
            cut = next((i + 1 for i in range(at + have - 1, at + max(t // 2, have - s), -1) if level[i] < quiet), None)
        else:
            cut = next((i + 1 for i in range(at + t, min(n, at + m)) if level[i] < quiet), None)
        if cut is None and (have >= m or not backwards and n - at >= m):
            out.append((at, at + m))
            at, have = at + m, t
        elif cut is not None:
            out.append((at, cut))
            at, have = max(at + 1, cut - o), t
        elif at + have >= n:
            break
        else:
            have += 10
    if at < n:
        out.append((at, n))
    return out


def tail_cuts(level: np.ndarray, step: float = 0.1, target: float = 24.0, run: int = 4, quiet: float = 0.012) -> list[int]:
    """Cuts of a growing dictation: in the middle of the first ``run`` quiet frames that start after the target; the target counts anew from each cut."""
    out, at, t = [], 0, round(target / step)
    low = np.append(level < quiet, False)
    i, count = t, 0
    while i < len(level):
        count = count + 1 if low[i] else 0
        i += 1
        if count == run:
            at = i - run + run // 2
            out.append(at)
            i, count = at + t, 0
    return out
