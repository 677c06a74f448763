"""Sessions, table loading and rounding rules used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the results rely on (UTC, ANSI, adaptive plans)."""
    return (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; zone-less timestamps become instants, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def total(c: Column | str, kind: str = "long") -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(kind)


def cents(c: Column | str) -> Column:
    """Two decimals: sums of doubles don't depend on their order beyond this."""
    return F.round(c, 2)
