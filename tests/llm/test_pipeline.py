"""The stages, and the entry with and without this subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def words(n, k):
    """``n`` words of which no three follow each other twice."""
    return " ".join(f"{'thandofinre'[(i * k) % 7:][:4]}{i * k + k}" for i in range(n))


def test_stages(spark, tmp_path):
    a, b, bad = words(120, 3), words(150, 5), "same again here " * 60
    item = " ".join(f"item{i}" for i in range(30))
    rows = [
        (5, a, "en", "x"), (3, a, "en", "y"), (9, a.replace("re6 ", "changed "), "en", "x"), (4, b, "en", "x"),
        (6, bad, "en", "x"), (7, None, None, None), (8, "short text", "en", "x"), (10, words(80, 7) + " " + item, "de", "x"),
        (11, words(90, 11) + " password=abcdef1", None, None), (4, b, "en", "x"), (None, words(70, 13), "en", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn(
        "n_chars", F.length("text").cast("long")).withColumn("kept", F.lit("clash")).withColumn("_k", F.lit(1))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append(sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i)))
        if name == "redact_secrets":
            assert docs.where("doc_id = 11").first().text.endswith(" [SECRET]")
    assert ids == [[3, 4, 4, 5, 9, 10, 11, None], [3, 4, 10, 11, None], [3, 4, 11, None], [3, 4, 11, None], [3, 4, 11, None]]


def test_nothing(spark, no_docs, folder):
    for name, stage in pipeline.STAGES:
        assert stage(spark, no_docs, folder).count() == 0, name


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert 0 < out.count() < 200 and out.where("taken > 2 * size").isEmpty()


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_entry_has_all():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 11))


def test_keys_tell_nulls_apart(spark):
    rows = [(5, "abc", None, "s", 3), (5, None, "abc", "s", 3), (5, None, None, "abc", 3), (None, "abc", None, "s", 3),
            (5, "abc", None, "s", None), (5, "abc", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline._keyed(docs).select("_k").distinct().count() == 5
