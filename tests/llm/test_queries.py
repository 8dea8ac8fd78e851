"""Each query itself, over the given tables: columns, types, folds, thresholds; and the trained ones with bare workers."""

import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.llm import registry

COLUMNS = {
    "op2_line_dedup": {"doc_id": "bigint", "n_removed": "bigint", "kept_chars": "bigint", "kept_sha256": "string", "removed_lines": "string"},
    "op3_licenses": {"doc_id": "bigint", "license_family": "string", "license_score": "double", "n_paragraphs": "bigint"},
    "op4_token_counts": {"context_limit": "bigint"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}
FOLD = {"op6_language": (3, 1), "op7_quality": (4, 2), "op10_toxicity": (5, 0)}
THRESHOLD = {"op7_quality": 0.7, "op10_toxicity": 0.5}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_keeps_its_contract(spark, sf_dir, name):
    out = registry.QUERIES[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert all(kinds[c] == t for c, t in COLUMNS[name].items())
    rows = out.collect()
    if "doc_id" in kinds:
        ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if "score" in kinds:
        assert all(0 <= r.score <= 1 for r in rows)
    if name in FOLD:
        n, rest = FOLD[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
    if name in THRESHOLD:
        assert all(r.predicted == int(r.score >= THRESHOLD[name]) for r in rows)


def test_no_lesson_comes_from_a_held_out_row(spark, sf_dir, tmp_path):
    """Labels and languages of held-out rows are turned round: nothing that is learned may change."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for name, (n, rest) in FOLD.items():
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest
        forged = f"{tmp_path}/{name}"
        docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{forged}/documents.parquet")
        turned = labels.select("doc_id", *[F.when(held, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
        turned.write.parquet(f"{forged}/labels.parquet")
        want = {r.doc_id: r.score for r in registry.QUERIES[name](spark, sf_dir).collect()}
        got = {r.doc_id: r.score for r in registry.QUERIES[name](spark, forged).collect()}
        assert got == pytest.approx(want), name


BARE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from millrace.llm import registry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name in ("op3_licenses", "op6_language", "op7_quality", "op8_bpe", "op9_ngram_jaccard", "op10_toxicity"):
    print(name, registry.QUERIES[name](spark, {sf_dir!r}).count())
"""


def test_workers_need_not_have_the_package(sf_dir, tmp_path):
    """The package is on the driver's path only: a worker that looked for it would not find it."""
    repo = str(Path(__file__).parents[2])
    code = BARE.format(repo=repo, sf_dir=sf_dir)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 12


@pytest.mark.parametrize("name", sorted(FOLD))
def test_a_crowd_of_rows_of_one_id_stays_within_the_sample(spark, monkeypatch, tmp_path, name):
    from millrace.llm import common

    most = []
    before = common.texts_of
    for module in ("common", "language", "licenses"):
        monkeypatch.setattr(
            f"millrace.llm.{module}.texts_of", lambda *a: most.append(rows := before(*a)) or rows
        )
    base = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word text "), F.col("id").cast("string")).alias("text"))
    more = spark.range(50).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("other words "), F.col("id").cast("string")).alias("text"))
    docs = base.unionByName(more).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    assert out.count() == 20_050
    assert most and all(len(rows) <= 51 for rows in most)
