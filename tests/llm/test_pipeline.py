"""The pipeline's stages, and the guards around the subpackage."""

import ast
from pathlib import Path

import corpus_pipeline
from compare import HERE, SF
from speechframe.llm import neardup
from speechframe.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and out.dtypes == docs.dtypes, name
            kept = out.count()
            assert 0.5 * docs.count() < kept <= docs.count(), name
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == kept


def test_rejected_and_redacted(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the and of with that this from have " * 5
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "12 34 !!", "en", "s", 8), (3, None, "en", "s", 0), (4, "le la les des une dans pour " * 5, "fr", "s", 1)], cols)
    assert {r.doc_id for r in corpus_pipeline.keep_identified(spark, docs, SF).collect()} == {1, 4}
    secret = spark.createDataFrame([(1, "token=abcdef1", "en", "s", 13), (2, "clean", "en", "s", 99)], cols)
    assert sorted(map(tuple, corpus_pipeline.redact_secrets(spark, secret, SF).collect())) == [(1, "[SECRET]", "en", "s", 8), (2, "clean", "en", "s", 99)]


def test_texts_in_another_language_than_claimed_go(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    en, fr = "the and of with that this from have ", "le la les des une dans pour avec "
    rows = [(k, en * 3 + f"word{'abcdefghij'[k % 10]}", "en", "s", 1) for k in range(40)] + [(100 + k, fr * 3 + f"mot{'abcdefghij'[k % 10]}", "fr", "s", 1) for k in range(20)]
    rows += [(200, fr * 5 + en, "en", "s", 1), (201, en * 5 + fr, "fr", "s", 1), (202, en * 5 + fr, "en", "s", 1), (203, fr * 5, None, "s", 1)]
    left = {r.doc_id for r in corpus_pipeline.keep_identified(spark, spark.createDataFrame(rows, cols), SF).collect()}
    assert left == {r[0] for r in rows} - {200, 201}


def test_stages_on_odd_tables(spark, tmp_path):
    """No rows; then nulls in every column, repeated rows, empty and long texts, and an extra column of a name used inside."""
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cols = "doc_id long, text string, lang string, source string, n_chars long, spans string, component_id long"
    rows = [(None, None, None, None, None, None, None), (1, "the and of", "en", "s", 10, "x", 5), (1, "the and of", "en", "s", 10, "x", 5), (2, "", "en", None, 0, None, None), (None, "the of and with", None, "s", 15, None, None),
            (3, "the and of " * 9000, "en", "s", 99_000, "y", 1), (4, "so alpha beta gamma delta epsilon zeta eta theta iota kappa it is", "en", "s", 60, "z", 2), (5, "token=abcdef1 the and of it", "en", "s", 27, "z", 2)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, cols)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert sorted((r.doc_id for r in docs.collect()), key=repr) == ([1, 1, 3, 5, None] if some else [])


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    again = neardup.groups(left, 5)
    assert again.where("not kept").count() == 0


def test_native_operators_have_no_python(spark):
    for name in ("op2_preferences", "op3_decontamination", "op11_curriculum"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_names():
    assert [n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in QUERIES) != 1] == [] and set(ORACLE_SQL) <= set(QUERIES)


def test_nothing_else_imports_llm():
    for p in Path(HERE, "speechframe").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in ast.unparse(node)
