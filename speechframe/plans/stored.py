"""Sources that are files of their own: written to the shared scratch folder, then read by the operators (S5, S6, S10, S14, S19, S20, K9); and recordings as bytes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from ..session import table
from ..operators.store import KeyedStore
from ..sources import binary, files
from ..storage import scratch
from .readings import INCIDENTS_SQL, incidents


@query("s5_k9_event_log", f"WITH {INCIDENTS_SQL} SELECT code, CAST(day AS VARCHAR) AS day, count(*) AS n FROM incidents GROUP BY 1, 2")
def s5(spark, d):
    """Appended event lines, some broken, read back; the text that must not be logged is gone."""
    out = scratch(spark, "log")
    e = incidents(spark, d).select(F.date_format("day", "yyyy-MM-dd").alias("ts"), "code", F.lit("error").alias("level"), F.create_map(F.lit("text"), F.lit("private"), F.lit("id"), F.col("event_id").cast("string")).alias("ctx"))
    files.append_events(e, out)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(out)
    log = files.jsonl(spark, out).where("not map_contains_key(ctx, 'text')")
    return log.groupBy("code", F.col("ts").alias("day")).agg(F.count("*").alias("n"))


@query("s6_json_documents", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey // 20 % 5 <> 0")
def s6(spark, d):
    """A document for every twenty suppliers; each fifth is broken and set aside."""
    out = scratch(spark, "voices")
    part = F.floor(F.col("s_suppkey") / 20)
    rows = table(spark, d, "supplier").groupBy(part.alias("part")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))).alias("value"))
    text = F.when(F.col("part") % 5 == 0, F.left("value", F.char_length("value") - 5)).otherwise(F.col("value"))
    binary.write_files(rows.select(F.concat(F.col("part").cast("string"), F.lit(".json")).alias("name"), text.cast("binary").alias("content")), out)
    good, _ = files.json_lists(spark, out, T.StructType().add("id", T.LongType()).add("name", T.StringType()))
    return good


@query("s10_term_file", "SELECT p_name AS term FROM part WHERE p_partkey % 3 = 0")
def s10(spark, d):
    out = scratch(spark, "terms")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("# "), "p_name")).otherwise(" ")
    table(spark, d, "part").select(line.alias("value")).write.text(out)
    return files.terms(spark, out)


@query("s19_csv_file", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def s19(spark, d):
    out = scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(out)
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").option("header", True).csv(out).where("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name")


@query("s14_importable", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'format' WHEN n_chars * 100000 > 209715200 THEN 'size' WHEN doc_id % 5 = 0 THEN 'short' END AS refused FROM documents")
def s14(spark, d):
    k = F.col("doc_id")
    f = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a/b."), F.when(k % 3 == 2, "txt").when(k % 3 == 1, "WAV").otherwise("m4a")).alias("path"), (F.col("n_chars") * 100_000).alias("length"), F.when(k % 5 == 0, 0.5).otherwise(0.6).alias("seconds"))
    return files.importable(f).select("doc_id", "refused")


SAMPLES_SQL = "g AS (SELECT user_id, list(CAST(floor(value * 16) AS INTEGER) % 32768 ORDER BY ts, event_id) AS s FROM events GROUP BY 1)"
FRAMES_SQL = """f AS (SELECT user_id, s, unnest(range(0, len(s), 8)) AS lo FROM {0}), p AS (SELECT user_id, lo // 8 AS frame_no, list_transform(s[lo + 1:lo + 8], lambda x: x / 32768.0) AS x FROM f)
    SELECT CAST(user_id AS VARCHAR) AS path, frame_no, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak FROM p"""


#: Fixed value: the format chunk of 16-bit mono PCM at 16 kHz, with its length.
FORMAT = "1000000001000100803E0000007D000002001000"


def little(c, digits: int):
    """The last bytes of a whole number in hex, the lowest byte first."""
    h = F.lpad(F.hex(c), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(digits // 2)])


def recordings(spark, d):
    """(path, content, n): a user's events as a 16-bit file whose head holds one more chunk before the samples."""
    x = (F.floor(F.col("value") * 16).cast("long") % 32768).alias("x")
    g = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", x))).alias("s"))
    body = F.array_join(F.transform("s", lambda s: little(s.x, 4)), "")
    head = F.concat(F.hex(F.lit("RIFF")), little(F.size("s") * 2 + 48, 8), F.hex(F.lit("WAVEfmt ")), F.lit(FORMAT), F.hex(F.lit("note")), F.lit("0400000000000000"), F.hex(F.lit("data")), little(F.size("s") * 2, 8))
    return g.select(F.col("user_id").cast("string").alias("path"), F.unhex(F.concat(head, body)).alias("content"), F.size("s").alias("n"))


def rounded_levels(df):
    return df.select("path", "frame_no", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


def stored(spark, d, share: float = 1.0):
    """The recordings as files of a folder, each up to a share of its bytes."""
    r = recordings(spark, d)
    size = F.ceil(F.octet_length("content") * share).cast("int")
    return r.select(F.concat("path", F.lit(".wav")).alias("name"), F.substring(F.col("content"), F.lit(1), size).alias("content"))


def by_user(df):
    return rounded_levels(df.withColumn("path", F.regexp_extract("path", r"([^/]+)\.wav$", 1)))


@query("s12_s13_recordings", f"WITH {SAMPLES_SQL}, {FRAMES_SQL.format('g')}")
def s12(spark, d):
    """Files read by byte range, several tasks a file; samples start after the data chunk's head, wherever that is."""
    out = scratch(spark, "recordings")
    binary.write_files(stored(spark, d), out)
    return by_user(binary.recorded_frames(spark, out, frame=8, split_bytes=1024))


@query("s11_growing_recording", f"SELECT * FROM (WITH {SAMPLES_SQL}, w AS (SELECT user_id, s[:len(s) // 8 * 8] AS s FROM g), {FRAMES_SQL.format('w')})")
def s11(spark, d):
    """Recordings that grow between two runs of one stream: every whole frame comes once."""
    out = scratch(spark, "growing")
    rows = f"{out}/rows"

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")

    from ..streaming.operators import drain

    for share in (0.4, 1.0):
        binary.write_files(stored(spark, d, share), f"{out}/files")
        drain(binary.growing_frames(spark, f"{out}/files", frame=8, split_bytes=2048), sink, f"{out}/state")
    return by_user(spark.read.schema(binary.FRAMES).parquet(f"{rows}/*"))


LINES_SQL = """l AS (SELECT event_id, ts, event_id || chr(9) || event_type || chr(9) || user_id AS line FROM events), s AS (SELECT *, strlen(line) + 1 AS size FROM l),
    b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000 AS g FROM s)"""


@query("k9_rotated_log", f"WITH {LINES_SQL} SELECT event_id, line, CAST((SELECT max(g) FROM b) - g AS BIGINT) AS age FROM b WHERE g >= (SELECT max(g) FROM b) - 1")
def k9(spark, d):
    """A log in generations of 20,000 bytes: the current one (0) and its backup (1)."""
    e = table(spark, d, "events").select("ts", "event_id", F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).alias("line"))
    return files.rotated(e, ["ts", "event_id"], "line", 20_000).select("event_id", "line", "age")


NOTE_SQL = "'---' || chr(10) || 'id: ' || conv_id || chr(10) || '---' || chr(10) || text"


@query("k12_stored_notes", f"SELECT conv_id, {NOTE_SQL} AS note, 1 + CAST(conv_id % 10 = 0 AS INTEGER) AS version FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn < 2 OR conv_id % 10 = 0) AS text FROM conversations GROUP BY 1) WHERE text IS NOT NULL")
def k12(spark, d):
    """Notes of meetings as they began, then of those that went on: an upsert by id that rewrites only the buckets it touches."""
    c = table(spark, d, "conversations")

    def notes(rows, version):
        body = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n").alias("text"))
        return body.select("conv_id", F.concat(F.lit("---\nid: "), F.col("conv_id").cast("string"), F.lit("\n---\n"), "text").alias("note"), F.lit(version).alias("version"))

    first = notes(c.where("turn < 2"), 1)
    store = KeyedStore(spark, scratch(spark, "notes"), first.schema, ["conv_id"], buckets=16)
    store.upsert(first, {"note": "replace", "version": "replace"}, 0)
    store.upsert(notes(c.where("conv_id % 10 = 0"), 2), {"note": "replace", "version": "replace"}, 1)
    return store.read()


@query("k10_atomic_files", "SELECT CAST(user_id AS VARCHAR) || '.json' AS name, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def k10(spark, d):
    """A file a user, written twice: each is the old or the new one, whole; side files are renamed at the job's commit."""
    out = scratch(spark, "atomic")
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    made = lambda x: n.select(F.concat(F.col("user_id").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct(x.alias("n"))).cast("binary").alias("content"))
    binary.write_files(made(F.lit(0)), out)
    binary.write_files(made(F.col("n")), out)
    read = spark.read.format("binaryFile").load(out)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.get_json_object(F.col("content").cast("string"), "$.n").cast("long").alias("n"))


@query("s17_levels_sidecar", f"WITH {SAMPLES_SQL}, b AS (SELECT user_id, s, unnest(range(0, len(s) // 2)) AS i FROM g) SELECT CAST(user_id AS VARCHAR) AS path, i AS block, round(s[2 * i + 1] / 32768.0, 6) AS mic_rms, round(s[2 * i + 2] / 32768.0, 6) AS sys_rms FROM b")
def s17(spark, d):
    """Pairs of floats; an odd one at the end is torn."""
    x = (F.floor(F.col("value") * 16).cast("long") % 32768).alias("x")
    g = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", x))).alias("s"))
    return files.levels(g.select("path", F.unhex(F.array_join(F.transform("s", lambda s: float_hex(s.x)), "")).alias("content"))).withColumns({c: F.round(c, 6) for c in ("mic_rms", "sys_rms")})


def float_hex(x):
    """x / 32768 of a whole x from 0 to 32767 as little-endian float32 in hex: the exponent is the place of x's highest bit."""
    top = F.char_length(F.bin(x)) - 1
    bits = F.when(x > 0, (top + 112) * 8_388_608 + (x * F.pow(F.lit(2.0), 23 - top)).cast("long") - 8_388_608).otherwise(F.lit(0).cast("long"))
    return little(bits, 8)


@query("s20_mismatched_files", "SELECT CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id % 10 = 0 OR doc_id % 10 = 1")
def s20(spark, d):
    """Files of a manifest that are missing or differ."""
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"), "doc_id")
    listed = x.select("name", F.octet_length("content").alias("size"), F.when(F.col("doc_id") % 10 == 0, F.lit("00")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return files.manifest_mismatches(listed, x.where("doc_id % 10 <> 1").select("name", "content"))
