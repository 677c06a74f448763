"""Near-duplicate groups by SetSketch registers.

1. Every text becomes the set of its distinct shingles of words; texts with
   equal sets collapse into one representative, their smallest id.
2. Representatives get SetSketch registers, banded into keys.  The members of a
   key are paired with its smallest member (a pre-aggregated minimum, joined
   back), never with each other.
3. The joint likelihood of the registers drops pairs that can't reach the
   threshold; the others are verified on their full sets.
4. Verified links give components.  Keys whose members lie in several components
   are looked at again, without limit, block against block: their registers
   first, then the texts of only those members that the likelihood leaves open
   between different components are verified, and a link per pair of components
   comes out.  Links inside one component are never looked at; they change no
   component.

A key, centre, set or node may hold any share of the rows: joins on them deal hot
ones to parts (``spread_join``), and what needs all rows of one is a
pre-aggregated minimum or count.

Words are runs of bytes other than the six ASCII white-space ones, A-Z
lower-cased; a text of fewer words than a shingle is one shingle.

Defined results: a null, empty or wordless text has the empty set and is linked
with nothing; a null id is linked with nothing and kept; rows that share an id
are linked, whatever their texts, and each of their texts is compared;
repeated texts are linked at similarity 1; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import sketch
from .common import cut_lineage, map_arrow, map_rows, schema, spread_join
from .components import components

#: Members verified beside one copy of their centre; members of a block that is compared with another.
BESIDE, BLOCK = 256, 256
#: Word hashes remembered by a task (the memory is emptied when full).
MEMORY = 150_000
#: Shingles of a cell's sets that are numbered at a time.
STRETCH = 1 << 18


class Shingler:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, size: int):
        from xxhash import xxh3_64_intdigest

        class Memory(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = h = xxh3_64_intdigest(word)
                return h

        self.size, self.memory = size, Memory()

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if len(self.memory) > MEMORY:
            self.memory.clear()
        h = np.fromiter(map(self.memory.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            out = sketch.mix(h[: len(h) - n + 1] + np.uint64(n))
            for k in range(1, n):
                out = sketch.mix(out * np.uint64(0x2545F4914F6CDD1D) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null for the empty set), regs of every row."""

    def make():
        from xxhash import xxh3_128_digest

        shingler = Shingler(shingle)

        def f(batch: pa.RecordBatch) -> list:
            sets = [shingler.of(t) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            regs = sketch.registers(np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes), sizes)
            return [batch.column(0), batch.column(1), sizes, [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [r.tobytes() if len(s) else None for r, s in zip(regs, sets)]]

        return f

    return map_rows(texts_of(docs).select("doc_id", "text_hash", "payload"), schema("doc_id long,text_hash long,n_shingles long,set_key binary,regs binary"), make)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, payload, text_hash): rows that share an id are told apart by the hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("payload")).withColumn("text_hash", F.xxhash64("payload"))


def banded(reps: DataFrame) -> DataFrame:
    """(key, node) of every band of every representative."""

    def make():
        def f(batch: pa.RecordBatch) -> list:
            regs = np.stack([np.frombuffer(r, np.int16) for r in batch.column(1).to_pylist()])
            return [sketch.band_keys(regs).ravel(), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sketch.BANDS)]

        return f

    return map_rows(reps.select("node", "regs"), schema("key long,node long"), make)


def streamed(pairs: DataFrame, sides: DataFrame, out: str, make) -> DataFrame:
    """Members beside their centre, without gathering a group.

    pairs: (c, x), one row a pair; sides: (node, payload) of either.
    The pairs of a centre are dealt to parts of about BESIDE; a part is a stretch of
    sorted rows that starts with the centre's own payload.  ``make()`` returns
    ``f(centre, its payload, [(x, payload), ...]) -> rows`` for pieces of a part.
    """
    counted = pairs.groupBy("c").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BESIDE).cast("int"))
    dealt = spread_join(pairs, counted, "c", "n", ["x"]).select("c", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "x")
    left = dealt.join(sides, F.col("x") == F.col("node")).select("c", "part", "role", "x", "payload")
    right = counted.join(sides, F.col("c") == F.col("node")).select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("c").alias("x"), "payload")
    kind = schema(out)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        centre = None
        for batch in batches:
            rows: list = []
            waiting: list = []
            c_now = None
            for c, role, x, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if role == 0:
                    if waiting:
                        rows += f(c_now, centre, waiting)
                        waiting = []
                    centre = data
                else:
                    c_now = c
                    waiting.append((x, data))
            if waiting:
                rows += f(c_now, centre, waiting)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t.type) for v, t in zip(zip(*rows), arrow)], schema=arrow)

    both = left.unionByName(right)
    return map_arrow(both.repartition("c", "part").sortWithinPartitions("c", "part", "role"), run, kind)


def plausible(pairs: DataFrame, sides: DataFrame, threshold: float) -> DataFrame:
    """The pairs (c, x) whose registers leave the threshold possible. sides: (node, n_shingles, regs)."""
    side = sides.select("node", F.struct("n_shingles", "regs").alias("payload"))

    def make():
        def f(c, centre, members):
            n = np.array([m["n_shingles"] for _, m in members], float)
            regs = np.stack([np.frombuffer(m["regs"], np.int16) for _, m in members])
            own = np.broadcast_to(np.frombuffer(centre["regs"], np.int16), regs.shape)
            ok = sketch.may_reach(threshold, np.full(len(n), float(centre["n_shingles"])), n, own, regs)
            return [(c, x) for (x, _), k in zip(members, ok) if k]

        return f

    return streamed(pairs, side, "c long,x long", make)


def per_cell(dealt: DataFrame, out: str, f) -> DataFrame:
    """f(rows, i, j) of every cell of dealt (c, i, j, ...), one cell at a time in memory; rows are lists of the other columns, results rows of ``out``."""
    arrow = to_arrow_schema(schema(out))
    width = len(dealt.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def made() -> Iterator[pa.RecordBatch]:
            found = f(rows, *cell[1:]) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t.type) for v, t in zip(zip(*found), arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for c, i, j, *row in zip(*(piece.column(k).to_pylist() for k in range(width))):
                    if cell != (c, i, j):
                        yield from made()
                        cell, rows = (c, i, j), []
                    rows.append(row)
        yield from made()

    return map_arrow(dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j"), run, schema(out))


def intersections(sets: list[np.ndarray | None], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[k] and y[k], which are sorted: one by one if few, else as products of 0/1 matrices.

    Hashes are spread evenly, so equal ranges of them hold about STRETCH shingles of all
    sets together; one range at a time is numbered and multiplied.
    """
    if len(x) <= 512:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x, y)], np.int64)
    used = np.unique(np.concatenate([x, y]))
    total = np.zeros((len(used), len(used)), np.float32)
    ranges = 1 + sum(len(sets[k]) for k in used) // STRETCH
    at = [0] * len(used)
    for r in range(1, ranges + 1):
        ends = [len(sets[k]) if r == ranges else int(np.searchsorted(sets[k], np.uint64((r << 64) // ranges))) for k in used]
        parts = [sets[k][a:b] for k, a, b in zip(used, at, ends)]
        at = ends
        owner = np.repeat(np.arange(len(used)), [len(p) for p in parts])
        values, codes = np.unique(np.concatenate(parts), return_inverse=True)
        order = np.argsort(codes, kind="stable")
        owner, codes = owner[order], codes[order]
        for lo in range(0, len(values), 8192):
            p, q = np.searchsorted(codes, [lo, lo + 8192])
            m = np.zeros((len(used), min(8192, len(values) - lo)), np.float32)
            m[owner[p:q], codes[p:q] - lo] = 1
            total += m @ m.T
    return total[np.searchsorted(used, x), np.searchsorted(used, y)].astype(np.int64)


def across_blocks(open_: DataFrame, sides: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between different components of members that share a key. open_: (c, node, component), c the smallest member of the key.

    Members of the keys with the same smallest member are one list; it is dealt to
    blocks of about BLOCK, and a task sees two blocks at a time.  It compares their
    registers and names the members of pairs that the likelihood leaves open; the
    texts of those alone come to their cell for a second look, which verifies full
    sets and emits a link per pair of components.  Neither pairs nor lists are
    gathered anywhere.
    """
    listed = cut_lineage(open_.distinct())
    counted = listed.groupBy("c").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = spread_join(listed, counted, "c", "n", ["node"]).join(sides.drop("payload"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = cells.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n_shingles", "regs")

    def open_pairs(rows: list[list], left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """rows: own, node, component, n_shingles, regs; pairs of the left block with the right (or within it, if they are the same) that may be links of two components."""
        block, _, comps, sizes = (np.array([r[k] for r in rows]) for k in range(4))
        x, y = np.triu_indices(len(rows), 1)
        cross = (comps[x] != comps[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
        if left != right:
            cross &= block[x] != block[y]
        x, y = x[cross], y[cross]
        regs = np.stack([np.frombuffer(r[4], np.int16) for r in rows])
        ok = np.zeros(len(x), bool)
        for at in range(0, len(x), 8192):
            p, q = x[at : at + 8192], y[at : at + 8192]
            ok[at : at + 8192] = sketch.may_reach(percent / 100, sizes[p].astype(float), sizes[q].astype(float), regs[p], regs[q])
        return x[ok], y[ok]

    def involved(rows: list[list], left: int, right: int) -> list[tuple]:
        x, y = open_pairs(rows, left, right)
        ids = rows[0][-1]
        return [(*ids, *rows[k][:3]) for k in np.unique(np.concatenate([x, y])).tolist()] if len(x) else []

    memory = []  # of the Python worker that runs a task

    def links(rows: list[list], left: int, right: int) -> list[tuple[int, int]]:
        x, y = open_pairs(rows, left, right)
        if not len(x):
            return []
        if not memory:
            memory.append(Shingler(shingle))
        used = set(x.tolist()) | set(y.tolist())
        sets = []
        for k, r in enumerate(rows):
            sets.append(memory[0].of(r[5]) if k in used else None)
            r[5] = None  # its set stands for it from here on
        same = intersections(sets, x, y)
        total = np.array([0 if v is None else len(v) for v in sets])
        link = 100 * same >= percent * (total[x] + total[y] - same)
        x, y = x[link], y[link]
        ids, comps = (np.array([r[k] for r in rows]) for k in (1, 2))
        lo, hi = np.minimum(comps[x], comps[y]), np.maximum(comps[x], comps[y])
        one = np.unique(np.stack([lo, hi]), axis=1, return_index=True)[1] if len(x) else []
        return [(int(ids[x[k]]), int(ids[y[k]])) for k in one]

    # The cell's own name rides along, as what comes out of the first look has to find its cell again.
    named = dealt.withColumn("name", F.array("c", F.col("i").cast("long"), F.col("j").cast("long")))
    first = per_cell(named, "c long,i int,j int,own int,node long,component long", involved)
    texts = first.join(sides, "node").select("c", "i", "j", "own", "node", "component", "n_shingles", "regs", "payload")
    return per_cell(texts, "a long,b long", links)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(c, x, inter, total) of pairs: sizes of the intersection and union of their full sets. texts: (node, payload)."""

    def make():
        shingler = Shingler(shingle)

        def f(c, centre, members):
            own, rows = shingler.of(centre), []
            for x, text in members:
                other = shingler.of(text)
                same = len(np.intersect1d(own, other, assume_unique=True))
                rows.append((c, x, same, len(own) + len(other) - same))
            return rows

        return f

    return streamed(pairs, texts, "c long,x long,inter long,total long", make)


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text) at a similarity of percent / 100 or more.

    One row per input row: doc_id, n_shingles, component_id, kept.
    """
    rows = cut_lineage(sketched(docs, shingle))
    known = rows.where("doc_id is not null and set_key is not null")
    repeated = cut_lineage(known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("n > 1"))
    some_repeat = not repeated.isEmpty()
    sets = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.count("*").alias("n"))
    # A set is a node of its own, numbered; its smallest id is a property of it.
    reps = cut_lineage(sets.select("set_key", "n", "head.*", "n_shingles", "regs").withColumn("node", F.monotonically_increasing_id()))
    bands = banded(reps)
    shared = cut_lineage(bands.groupBy("key").agg(F.min("node").alias("c"), F.count("*").alias("n")).where("n > 1"))
    # Members of the keys that more than one representative has, with the key's smallest one, and their texts: all that is looked at from here on.
    members = cut_lineage(spread_join(bands, shared, "key", "n", ["node"]))
    texts = texts_of(docs)
    if some_repeat:  # rows equal in id and text are one
        alike = spread_join(texts, repeated.select("doc_id", "n"), "doc_id", "n", ["text_hash"]).dropDuplicates(["doc_id", "text_hash"])
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(alike)
    involved = reps.select("node", "doc_id", "text_hash", "n_shingles", "regs").join(members.select("node").distinct(), "node", "left_semi")
    sides = cut_lineage(texts.join(involved, ["doc_id", "text_hash"]).select("node", "payload", "n_shingles", "regs"))
    # A first look: every member with its key's smallest one.
    pairs = cut_lineage(members.where("node <> c").select("c", F.col("node").alias("x")).distinct())
    seen = verified(cut_lineage(plausible(pairs, sides, percent / 100)), sides.select("node", "payload"), shingle)
    links = seen.where(f"100 * inter >= {percent} * total").select(F.col("c").alias("a"), F.col("x").alias("b"))
    if some_repeat:
        links = links.unionByName(same_id(known, repeated, reps))
    links = cut_lineage(links)
    found = cut_lineage(components(links))
    # A second look, at the keys that hold several components.
    named = members.join(found, "node", "left").select("key", "c", "node", F.coalesce("component", "node").alias("component"))
    mixed = cut_lineage(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"))
    more = across_blocks(spread_join(named, mixed, "key", "n", ["node"]).select("c", "node", "component"), sides, shingle, percent)
    found = components(links.unionByName(more))

    labelled = cut_lineage(reps.select("node", "set_key", "n", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    rep_of = spread_join(labelled.drop("doc_id"), least, "component", "members", ["node"]).select("set_key", "n", "component_id")
    out = spread_join(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")), rep_of, "set_key", "n", ["doc_id"], "left", counts=reps.select("set_key", "n"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def same_id(known: DataFrame, repeated: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the sets that rows of one id have: each with the smallest node of them."""
    several = repeated.where("lo <> hi").select("doc_id", "n")
    rows = spread_join(known.select("doc_id", "set_key"), several, "doc_id", "n", ["set_key"]).distinct()
    nodes = cut_lineage(spread_join(rows, reps.select("set_key", "n", "node"), "set_key", "n", ["doc_id"]).select("doc_id", "node"))
    stars = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    return spread_join(nodes, stars, "doc_id", "n", ["node"]).where("a <> node").select("a", F.col("node").alias("b"))


def distinct_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their group, and those without an id, with all their columns. Rows that repeat an id stay or go together."""
    kept = groups(docs, shingle, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").unionByName(docs.where("doc_id is null"))
