"""The pipeline's stages: columns, decisions, and the whole over small tables."""

import corpus_pipeline as cp
from millrace.llm import registry

CLEAN = [
    " ".join(f"the{w}of and{(w * 7 + i) % 83}ing her{(w * 5 + i) % 71}tion" for w in range(8)) for i in range(30)
]


def test_stages_and_registry():
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


def test_run_keeps_clean_documents(spark, sf_dir, tmp_path):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 0").first().text
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(CLEAN)]
    rows += [
        (100, CLEAN[3], "en", "s", 9),  # an exact copy: its line goes, its text is empty, it is its own component
        (101, "Start " + bench + " end", "en", "s", 9),
        (102, "123 456", None, None, None),
        (103, None, None, None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(range(30)) <= out and out.isdisjoint({101, 102, 103})


def test_every_stage_returns_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [
        (7, text, "a"), (3, text + " x", "b"), (3, text + " x", "b"), (3, "other words " * 3, "c"), (None, text + " y", "d"),
        (None, None, "e"), (None, None, "e"), (9, "", "f"), (None, "alone " + text[::-1], "g"), (None, "alone " + text[::-1], "g"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((str(r.doc_id), r.row) for r in cp.near_duplicates_out(spark, df, "").collect())
    assert got == [("3", "b"), ("3", "c"), ("9", "f"), ("None", "e"), ("None", "e"), ("None", "g")]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_rejected string, removed string, __removed string, __id string, __key string, row string, th string, key string, node string, component string, kept string, `a.b` string"


def test_stages_over_clashing_names_and_awkward_rows(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 0").first().text
    long = " ".join(f"wo{i % 997}rd the{i % 1013}" for i in range(30_000))
    texts = [*CLEAN, CLEAN[0], bench, None, "", long, "\n".join(CLEAN[:3] * 50)]
    rows = [(i if i % 9 else None, t, "en", "s", None if t is None else len(t), *"abcdefghijklm") for i, t in enumerate(texts)]
    rows += rows[:4]
    docs = spark.createDataFrame(rows, CLASH)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert got, name
        if name != "byte-level BPE":
            assert out.columns == docs.columns, name
            assert all(r["a.b"] == "m" and r["lang_pred"] == "a" for r in got), name
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.collect() == [], name
        if name == "line dedup":
            assert len(got) == len(rows)
        if name == "benchmark decontamination":
            assert len(got) == len(rows) - 1
