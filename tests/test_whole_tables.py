"""Queries without SQL answer for all turns and vectors."""

from pyspark.sql import functions as F

from compare import SF
from speechframe.plans.timeline import turns
from speechframe.queries import QUERIES


def test_every_turn(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    assert turns(spark, SF).count() == c.count()
    late = turns(spark, SF).where("ord % 3 = 2 and `end` <= start").count()
    assert late == 0


def test_window_join_counts_all_words(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("n"))
    want = {r.conv_id: r.n for r in c.groupBy("conv_id").agg(F.sum("n").alias("n")).collect()}
    assert {r.conv_id: r.n_words for r in QUERIES["w17_window_join"](spark, SF).collect()} == want


def test_even_vectors_are_probed(spark):
    ids = {r.vec_id for r in QUERIES["j11_v17_assignment"](spark, SF).collect()}
    assert any(i % 2 == 0 for i in ids) and any(i % 2 for i in ids)
