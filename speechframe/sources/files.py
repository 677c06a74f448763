"""File sources and sinks: JSON lines, JSON documents, rules, term lists, CSV, WAV, sidecars, exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut, running_total

EVENTS = T.StructType([T.StructField("ts", T.StringType()), T.StructField("code", T.StringType()), T.StructField("level", T.StringType()), T.StructField("ctx", T.MapType(T.StringType(), T.StringType()))])
RULES = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("default", T.StringType()),
    T.StructField("buckets", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("note", T.StringType()), T.StructField("section", T.StringType()), T.StructField("as_task", T.BooleanType()), T.StructField("keywords", T.ArrayType(T.StringType()))]))),
])


def jsonl(spark: SparkSession, path: str, schema: T.StructType = EVENTS) -> DataFrame:
    """Event lines; broken ones are skipped. Lines are read as text, so one of the wrong shape can't fail the scan."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).where("e is not null and e.code is not null").select("e.*")


def json_lists(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Whole-file JSON lists: their rows, and the paths of files that aren't such a list (set aside by the caller)."""
    parsed = F.from_json("value", T.ArrayType(schema))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parsed.alias("rows"))
    return files.where("rows is not null").select(F.inline("rows")), files.where("rows is null").select("path")


def settings(documents: DataFrame, column: str, renamed: dict[str, dict[str, str]]) -> DataFrame:
    """Schemaless settings as a map of strings, with old values of a key replaced by new ones."""
    m = F.from_json(column, T.MapType(T.StringType(), T.StringType()))
    new = F.transform_values(m, lambda k, v: _chain(k, v, renamed))
    return documents.withColumn("settings", new)


def _chain(k: Column, v: Column, renamed: dict[str, dict[str, str]]) -> Column:
    out = v
    for key, values in renamed.items():
        for old, new in values.items():
            out = F.when((k == key) & (v == old), F.lit(new)).otherwise(out)
    return out


def rules(documents: DataFrame, column: str, default: str) -> DataFrame:
    """Routing rules; the default document where one is missing or broken."""
    parsed = F.from_json(column, RULES)
    usable = F.when(F.size(parsed["buckets"]) > 0, parsed)
    return documents.withColumn("rules", F.coalesce(usable, F.from_json(F.lit(default), RULES)))


def active_entry(entries: DataFrame, key: str, opened: str, at: str, tie: str) -> DataFrame:
    """One entry a key: an open one first, else the latest; ties to the smaller ``tie``."""
    rank = F.struct(F.coalesce(F.col(opened), F.lit(False)).cast("int"), F.col(at), -F.col(tie))
    return entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), rank).alias("e")).select(key, "e.*")


def terms(spark: SparkSession, path: str) -> DataFrame:
    """A term a line; blank lines and those that start with # are none."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> '' and not startswith(term, '#')")


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """An older table under a newer schema: missing columns are null, unknown ones go."""
    spark = df.sparkSession
    return spark.createDataFrame([], schema).unionByName(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns]), allowMissingColumns=True)


def wav_data_offset(head: bytes) -> int:
    """Where the samples of a RIFF file start: after the data chunk's 8 bytes in its first 4 KiB, else 44."""
    at = head[:4096].find(b"data")
    return at + 8 if at >= 0 else 44


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def levels(sidecars: DataFrame) -> DataFrame:
    """(path, block, mic_rms, sys_rms) of N x 2 little-endian float32 contents; a torn last pair is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                v = np.frombuffer(content or b"", "<f4", count=len(content or b"") // 8 * 2).reshape(-1, 2)
                yield pd.DataFrame({"path": name, "block": np.arange(len(v), dtype=np.int64), "mic_rms": v[:, 0].astype(float), "sys_rms": v[:, 1].astype(float)})

    return sidecars.select("path", "content").mapInPandas(run, "path string, block long, mic_rms double, sys_rms double")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    return levels(contents(spark, path))


def importable(files: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Adds why a file can't be imported (null if it can): its ending, its size, its length."""
    ending = F.lower(F.substring_index("path", ".", -1))
    known = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "opus", "mp4", "mov", "webm")  # fixed values
    return files.withColumn("refused", F.when(~ending.isin(*known), "format").when(F.col("length") > 200 * 1024 * 1024, "size").when(F.col(seconds) < 0.6, "short"))


def manifest_mismatches(listed: DataFrame, content: DataFrame) -> DataFrame:
    """Files of a manifest (name, size, sha256) that are missing or differ from ``content`` (name, content)."""
    have = content.select("name", F.octet_length("content").alias("has_size"), F.sha2("content", 256).alias("has_sha"))
    return listed.join(have, "name", "left").where(F.col("has_sha").isNull() | (F.col("has_size") != F.col("size")) | (F.col("has_sha") != F.lower("sha256"))).select("name")


def append_events(events: DataFrame, path: str) -> None:
    """Appends event lines, without the text that must not be logged. Each call adds files; a reader takes the folder."""
    events.withColumn("ctx", F.map_filter("ctx", lambda k, v: k != "text")).write.mode("append").json(path)


def rotated(lines: DataFrame, order: list[str], line: str, limit: int = 2_000_000, keep: int = 2) -> DataFrame:
    """The last ``keep`` generations of a log, with ``age`` (0 is the current one).

    A generation ends with the line that reaches the next multiple of ``limit`` bytes, a line feed after each line counted in.
    Running totals are prefix sums over range-sorted partitions, so no task sees the whole log.
    """
    sized = lines.withColumn("__size", F.coalesce(F.octet_length(line), F.lit(0)).cast("long") + 1)
    dealt = cut(running_total(sized, order, "__size", "__before").withColumn("__gen", F.floor(F.col("__before") / limit)).drop("__size", "__before"))
    last = dealt.agg(F.max("__gen")).first()[0]
    return dealt.withColumn("age", F.lit(last).cast("long") - F.col("__gen")).where(F.col("age") < keep).drop("__gen")


def templated(df: DataFrame, template: str, fields: list[str]) -> Column:
    """The template with every {{field}} filled in; an unfilled one fails the row."""
    out = F.lit(template)
    for f in fields:
        out = F.replace(out, F.lit("{{" + f + "}}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
    return F.when(F.contains(out, F.lit("{{")), F.raise_error(F.concat(F.lit("unfilled field in: "), out))).otherwise(out)
