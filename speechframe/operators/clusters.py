"""Clustering of the voices of one meeting, and voice banks.

A meeting's regions are few by nature (hours of speech make thousands), and
greedy merging looks at its own result, so a meeting is a group of
``applyInPandas``; everything across meetings stays a DataFrame operation.
Results are seeded and defined up to the numbering of labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import BANK_ROWS, BLOCK, best_of, bounded, doubles

#: Least silhouette of more than one voice; cost of a turn; thresholds of merging by the seconds of the shorter cluster.
LEAST_SILHOUETTE, TURN_COST = 0.12, 0.40
MERGE_AT = ((8.0, 0.46), (20.0, 0.52), (60.0, 0.58), (float("inf"), 0.65))
LEAST_LINKS, LEAST_RATE = 3, 0.30


def _units(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-9)


def means(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Unit centroids by label 0..K-1."""
    onehot = np.eye(labels.max() + 1)[labels]
    return _units(onehot.T @ x / np.maximum(onehot.sum(0)[:, None], 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 25, starts: int = 8) -> np.ndarray:
    """Spherical k-means: far-apart seeds, the most cohesive of several seeded starts."""
    n = len(x)
    if k <= 1 or n < k:
        return np.zeros(n, int)
    rng, best, most = np.random.default_rng(k), None, -np.inf
    for _ in range(starts):
        seeds = [int(rng.integers(n))]
        while len(seeds) < k:
            far = np.clip(1 - (x @ x[seeds].T).max(1), 0, None)
            seeds.append(int(rng.choice(n, p=far / far.sum() if far.sum() > 0 else None)))
        centres, labels = x[seeds].copy(), None
        for _ in range(rounds):
            now = (x @ centres.T).argmax(1)
            if labels is not None and (now == labels).all():
                break
            labels = now
            for j in range(k):
                if (labels == j).any():
                    centres[j] = _units(x[labels == j].mean(0))
        labels = (x @ centres.T).argmax(1)
        cohesion = float((x * centres[labels]).sum())
        if cohesion > most:
            best, most = labels, cohesion
    return renumbered(best)


def renumbered(labels: np.ndarray) -> np.ndarray:
    """Labels 0.. in the order of their values."""
    return np.unique(labels, return_inverse=True)[1]


def silhouette_of(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette over cosine distance, of all rows."""
    if labels.max(initial=0) < 1:
        return -1.0
    onehot = np.eye(labels.max() + 1)[labels]
    size = onehot.sum(0)
    total = (1 - x @ x.T) @ onehot
    row = np.arange(len(x))
    own = total[row, labels] / np.maximum(size[labels] - 1, 1)
    other = total / size
    other[row, labels] = np.inf
    near = other.min(1)
    return float(np.mean((near - own) / (np.maximum(near, own) + 1e-9)))


def spectral_count(x: np.ndarray, most: int, cap: int = 2500) -> tuple[int, float] | None:
    """Number of voices by the largest gap of the normalised Laplacian's spectrum, the sharpest of three neighbourhood sizes; None if there are under 8 rows or no connected graph."""
    n = len(x)
    if n < 8:
        return None
    if n > cap:
        x = x[np.linspace(0, n - 1, cap).astype(int)]
        n = cap
    cosine, best = x @ x.T, None
    most = max(1, min(most, n - 2))
    for share in (0.1, 0.2, 0.3):
        p = min(n - 1, max(5, int(share * n)))
        near = np.argpartition(-cosine, p - 1, axis=1)[:, :p]
        graph = np.zeros_like(cosine)
        np.put_along_axis(graph, near, np.take_along_axis(cosine, near, 1), 1)
        graph = np.maximum(graph, graph.T)
        np.fill_diagonal(graph, 0)
        scale = 1 / np.sqrt(np.maximum(graph.sum(1), 1e-9))
        spectrum = np.linalg.eigvalsh(np.eye(n) - scale[:, None] * graph * scale)[: most + 1]
        if len(spectrum) < 3 or spectrum[1] < 1e-6:
            continue
        gaps = np.diff(spectrum)[:most]
        k = int(gaps.argmax())
        sharp = gaps[k] / max(gaps.sum(), 1e-9)
        if best is None or sharp > best[1]:
            best = (k + 1, float(sharp))
    return best


def count_voices(x: np.ndarray, most: int = 8) -> tuple[int, np.ndarray, float]:
    """K, labels and silhouette: the spectral count, or the best silhouette where it abstains; one voice where the silhouette is too low."""
    one = np.zeros(len(x), int)
    most = min(most, len(x) - 1)
    if most < 2:
        return 1, one, -1.0
    spectral = spectral_count(x, most)
    if spectral is not None and spectral[0] < 2:
        return 1, one, -1.0
    tried = [kmeans(x, k) for k in ([spectral[0]] if spectral else range(2, most + 1))]
    scores = [silhouette_of(x, t) for t in tried]
    best = int(np.argmax(scores))
    if scores[best] < LEAST_SILHOUETTE:
        return 1, one, scores[best]
    return int(tried[best].max()) + 1, tried[best], scores[best]


def merge_alike(x: np.ndarray, labels: np.ndarray, seconds: np.ndarray | None = None) -> np.ndarray:
    """Joins the pair of clusters whose centroids most exceed the threshold for the shorter one's speech, again and again."""
    labels = renumbered(labels)
    while labels.max(initial=0) > 0:
        c = means(x, labels)
        excess = np.full((len(c), len(c)), -np.inf)
        spoken = np.bincount(labels, seconds) if seconds is not None else np.full(len(c), np.inf)
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                excess[i, j] = c[i] @ c[j] - next(t for s, t in MERGE_AT if min(spoken[i], spoken[j]) < s or s == np.inf)
        i, j = np.unravel_index(excess.argmax(), excess.shape)
        if excess[i, j] < 0:
            break
        labels = renumbered(np.where(labels == j, i, labels))
    return labels


def merge_linked(labels: np.ndarray, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Joins the two labels that neighbours in time inside one segment link most, again and again, while the evidence is enough."""
    order = np.argsort(start, kind="stable")
    inside = segment[order][1:] == segment[order][:-1]
    labels = renumbered(labels)
    while labels.max(initial=0) > 0:
        a, b = labels[order][:-1], labels[order][1:]
        k = labels.max() + 1
        pair = np.where(a != b, np.minimum(a, b) * k + np.maximum(a, b), -1)
        adjacent = np.bincount(pair[pair >= 0], minlength=k * k)
        links = np.bincount(pair[(pair >= 0) & inside], minlength=k * k)
        rate = np.where((links >= LEAST_LINKS) & (adjacent > 0), links / np.maximum(adjacent, 1), 0)
        best = int(rate.argmax())
        if rate[best] < LEAST_RATE:
            break
        labels = renumbered(np.where(labels == best % k, best // k, labels))
    return labels


def dissolved(labels: np.ndarray, t0: np.ndarray, t1: np.ndarray, least_s: float = 3.0, share: float = 0.02) -> np.ndarray:
    spoken = np.bincount(labels, t1 - t0)
    major = (spoken >= least_s) | (spoken / max(spoken.sum(), 1e-9) >= share)
    if not major.any():
        major[spoken.argmax()] = True
    centre, keep = (t0 + t1) / 2, np.flatnonzero(major[labels])
    near = keep[np.abs(centre[keep][None, :] - centre[:, None]).argmin(1)]
    return renumbered(np.where(major[labels], labels, labels[near]))


def viterbi(x: np.ndarray, centres: np.ndarray, cost: float = TURN_COST) -> np.ndarray:
    """Labels of rows in time that maximise cosine less a cost per change."""
    score = x @ centres.T
    n, k = score.shape
    if n == 0 or k <= 1:
        return np.zeros(n, int)
    total, back = score[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        best = int(total.argmax())
        switch = total < total[best] - cost
        back[i] = np.where(switch, best, np.arange(k))
        total = np.where(switch, total[best] - cost, total) + score[i]
    out = np.zeros(n, int)
    out[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def automatic(x: np.ndarray, t0: np.ndarray, t1: np.ndarray, segment: np.ndarray, most: int, forced: int = 0) -> np.ndarray:
    """Labels of a meeting's regions. A forced number of voices is neither merged nor dissolved."""
    if forced:
        return kmeans(x, forced)
    labels = count_voices(x, most)[1]
    labels = merge_alike(x, labels, t1 - t0)
    return dissolved(merge_linked(labels, t0, segment), t0, t1)


def per_meeting(regions: DataFrame, what: str, k: int) -> DataFrame:
    """(meeting, ord, label) of regions (meeting, ord, t0, t1, seg_id, v); for "count" (meeting, ord = 0, label = number of voices)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        x = _units(np.stack(pdf["v"].to_numpy()).astype(float))
        t0, t1, seg = (pdf[c].to_numpy() for c in ("t0", "t1", "seg_id"))
        if what == "count":
            return pd.DataFrame({"meeting": pdf["meeting"].iloc[:1], "ord": 0, "label": count_voices(x, k)[0]})
        if what == "kmeans":
            labels = kmeans(x, k)
        elif what == "merged":
            labels = merge_linked(merge_alike(x, kmeans(x, k), t1 - t0), t0, seg)
        elif what == "viterbi":
            labels = viterbi(x, means(x, kmeans(x, k)))
        else:
            labels = automatic(x, t0, t1, seg, k)
        return pd.DataFrame({"meeting": pdf["meeting"].to_numpy(), "ord": pdf["ord"].to_numpy(), "label": labels})

    return regions.groupBy("meeting").applyInPandas(run, "meeting long, ord long, label long")


def silhouette(df: DataFrame, label: str, vector: str, ident: str, most: int = BANK_ROWS, block: int = BLOCK) -> DataFrame:
    """Exact mean silhouette over cosine distance of unit vectors.

    The mean distance of x to a label of n vectors with sum s is 1 - x.s / n (its own label: with x itself taken out), so only
    the label sums meet the rows: all at once if there are at most ``most``, as counted first, else block by block.
    """
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("own"), doubles(vector).alias("v"))
    parts = rows.select("own", F.posexplode("v").alias("i", "x")).groupBy("own", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = parts.groupBy("own").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("s"), F.max("n").alias("n"))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    few = bounded(sums, most)
    if few is not None:
        one = few.agg(F.collect_list(F.struct("own", "s", "n")).alias("all"))
        j = rows.join(F.broadcast(one)).withColumn("mine", F.filter("all", lambda c: c.own == F.col("own"))[0])
        j = j.withColumn("b", F.array_min(F.transform(F.filter("all", lambda c: c.own != F.col("own")), lambda c: 1 - product(F.col("v"), c.s) / c.n)))
    else:
        n, m = (max(1, -(-x.count() // block)) for x in (rows, sums))
        means = sums.select(F.col("own").alias("y"), F.transform("s", lambda x: x / F.col("n")).alias("v"))
        others = best_of(rows.withColumnRenamed("id", "x"), means, 1, n, m).select(F.col("x").alias("id"), (1 - F.col("cosine")).alias("b"))
        j = rows.join(sums.select("own", F.struct("s", "n").alias("mine")), "own").join(others, "id", "left")
    v, own = F.col("v"), F.col("mine")
    a = F.when(own["n"] > 1, 1 - (product(v, own["s"]) - product(v, v)) / (own["n"] - 1)).otherwise(0.0)
    return j.select(a.alias("a"), "b").agg(F.coalesce(F.avg((F.col("b") - F.col("a")) / (F.greatest("a", "b") + 1e-9)), F.lit(-1.0)).alias("silhouette"))


def even_subsample(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even places of the order (all, if there are fewer).

    Places are found from the rows before each range partition: no window over the whole table.
    """
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    parts = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("c"))
    before = sizes.withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    at = parts.join(F.broadcast(before), "__p").withColumn("__i", F.col("b") + F.col("__r"))
    # A place i is taken if some k has floor(k (total - 1) / (n - 1)) = i.
    k = F.ceil(F.col("__i") * (n - 1) / F.greatest(F.lit(1), F.col("total") - 1))
    taken = (F.col("total") <= n) | (F.floor(k * (F.col("total") - 1) / F.lit(float(n - 1))) == F.col("__i"))
    return at.where(taken).drop("__p", "__r", "__i", "c", "b", "total")


def enrolled(known: DataFrame, new: DataFrame, key: str = "bank", least_s: float = 12.0) -> DataFrame:
    """Banks of voices after each piece of new evidence, in order: time-weighted mean, made unit at each step; a new dimension replaces.

    known: (bank, id, name, centroid, seconds, meetings); new: (bank, ord, id or null, name, centroid, seconds).
    Refused: blank or placeholder names, too little speech, a zero vector.  A voice is found by its id, else
    by its name in any case, as it is at that moment; else it is new, with the id after the largest.  Names
    change with evidence, so a bank (the voices one install knows, some hundreds) is one ordered group.
    """
    from ..functions.checks import placeholder

    name = F.trim(F.coalesce("name", F.lit("")))
    fit = new.withColumn("name", name).where((name != "") & ~placeholder(name) & (F.col("seconds") >= least_s) & (F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x) >= 1e-8))
    columns = [key, F.col("id").cast("long").alias("id"), "name", "centroid", "seconds"]
    rows = known.select(*columns, "meetings", F.lit(-1).cast("long").alias("ord")).unionByName(fit.select(*columns, F.lit(None).cast("int").alias("meetings"), F.col("ord").cast("long").alias("ord")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        voices: dict[int, list] = {}
        for r in pdf.sort_values(["ord", "id"], kind="stable").to_dict("records"):
            c, seconds = np.asarray(r["centroid"], float), float(r["seconds"])
            if r["ord"] < 0:
                voices[int(r["id"])] = [r["name"], _units(c), seconds, int(r["meetings"])]
                continue
            at = int(r["id"]) if pd.notna(r["id"]) and int(r["id"]) in voices else next((k for k, v in voices.items() if v[0].lower() == r["name"].lower()), None)
            if at is None:
                voices[max(voices, default=0) + 1] = [r["name"], _units(c), seconds, 1]
                continue
            _, old, before, met = voices[at]
            if len(old) == len(c):
                c, seconds = old * before + c * seconds, before + seconds
            voices[at] = [r["name"], _units(c), seconds, met + 1]
        return pd.DataFrame([(pdf[key].iloc[0], k, n, v, s, m) for k, (n, v, s, m) in voices.items()], columns=[key, "id", "name", "centroid", "seconds", "meetings"])

    return rows.groupBy(key).applyInPandas(fold, f"{key} long, id long, name string, centroid array<double>, seconds double, meetings int")


def one_to_one(scored: DataFrame, meeting: str, left: str, right: str, score: str) -> DataFrame:
    """Greedy one-to-one pairs of a meeting, the highest score first (ties: smaller left, then right)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, keep = set(), set(), []
        for r in pdf.sort_values([score, left, right], ascending=[False, True, True]).itertuples():
            a, b = getattr(r, left), getattr(r, right)
            if a not in used_l and b not in used_r:
                used_l.add(a), used_r.add(b), keep.append(r.Index)
        return pdf.loc[keep, [meeting, left, right]]

    return scored.where(F.col(right).isNotNull()).select(meeting, left, F.col(right).cast("long").alias(right), score).groupBy(meeting).applyInPandas(run, f"{meeting} long, {left} long, {right} long")


class BatchFailed(Exception):
    """What a mapped function raises when its batch can't be worked on; anything else is a bug and fails the job."""


#: Batches of a group of rows: few enough to spread a key, as many as make a group's own cost small.
BATCHES = 128


def isolated(df: DataFrame, key: str, order: str, size: int, f: Callable[[pd.DataFrame], pd.DataFrame], made: str) -> DataFrame:
    """df with the columns ``made`` (DDL) of f over batches of ``size`` rows of a key in order.

    A batch that fails has nulls there; where a key's first one fails, its whole result is null, as then the means of
    working are taken to be missing. f gets one batch at a time; groups are of ``BATCHES`` batches, so a key is spread over tasks.
    """
    own = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in df.schema)
    names = [x.split()[0] for x in made.split(",")]
    numbered = df.withColumn("__batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("long"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = g.sort_values(["__batch", order], kind="stable").reset_index(drop=True)
        batch, given = rows["__batch"].to_numpy(), rows.drop(columns=["__batch", "__block"])
        at = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(rows)]
        done, failed = [], []
        for lo, hi in zip(at, at[1:]):
            b = given.iloc[lo:hi].reset_index(drop=True)
            try:
                done.append(f(b))
                failed.append(False)
            except BatchFailed:
                done.append(b.assign(**dict.fromkeys(names)))
                failed.append(True)
        sizes = [len(b) for b in done]
        # Values as they are: a column of numbers and nulls would be one of doubles.
        own = {c: pd.Series([x for b in done for x in b[c].tolist()], dtype=object) for c in names}
        kept = pd.concat([b.drop(columns=names) for b in done], ignore_index=True)
        return kept.assign(**own, __batch=np.repeat(batch[at[:-1]], sizes), __failed=np.repeat(failed, sizes))

    blocks = numbered.withColumn("__block", F.floor(F.col("__batch") / BATCHES))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given: rows are small beside the work on them
    out = blocks.repartition(n, key, "__block").groupBy(key, "__block").applyInPandas(run, f"{own}, {made}, __batch long, __failed boolean")
    lost = F.max(F.when(F.col("__batch") == 0, F.col("__failed"))).over(Window.partitionBy(key))
    return out.withColumn("__lost", lost).withColumns({c: F.when(~F.col("__lost"), F.col(c)) for c in names}).drop("__batch", "__failed", "__lost")
