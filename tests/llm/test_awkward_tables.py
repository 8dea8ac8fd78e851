"""Every query over a table of awkward rows, and over empty tables: nothing crashes, no row is lost, equal rows get equal results."""

from collections import defaultdict

import pytest

from millrace.llm import registry

#: Columns of the documents, and further ones that the operators use as names of their own.
CLASH = "n_words n_tokens score key token h at id n p w t rank size row th node component kept held_out predicted lang_pred host text_a fails"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH.split())


def rows():
    plain = [f"the {w} of and ing tion ent {w * 3} her ha licence {w}" for w in ("stone", "river", "cloud", "night")]
    long = " ".join(f"wo{i % 1999}rd the{i % 2003}" for i in range(40_000))
    texts = [*plain, None, "", " \n\t", "one", "12 !!", plain[0].upper(), long, long + " end", "\n".join(plain * 200)]
    texts += ["Released under the MIT License.\n" + plain[1], "😀 éß 中文"]
    found = [(i if i != 3 else None, t, "en" if i % 3 else None, "s" if i % 4 else None, None) for i, t in enumerate(texts)]
    found += found[:6] + found[:2] + [(0, "another text of the first id here and there", "de", "s", 3)]
    return [r + tuple("abcdefghijklmnopqrstuvwxyz"[: len(CLASH.split())]) for r in found]


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    awkward, empty = (str(tmp_path_factory.mktemp(n)) for n in ("awkward", "empty"))
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, None if i == 2 else i % 2, "x") for i in [*range(12), 3, 500]] + [(None, 1, 1, "x")], "doc_id long, quality int, toxic int, score string")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for folder, keep in ((awkward, "true"), (empty, "false")):
        docs.where(keep).write.parquet(f"{folder}/documents.parquet")
        labels.where(keep).write.parquet(f"{folder}/labels.parquet")
        bench.where(keep).write.parquet(f"{folder}/benchmark.parquet")
    return awkward, empty


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_awkward_rows(spark, folders, name):
    awkward, empty = folders
    got = registry.QUERIES[name](spark, awkward).collect()
    assert registry.QUERIES[name](spark, empty).collect() == []
    if name == "op4_token_counts":
        assert got
        return
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    if name in ("op6_language", "op3_licenses", "op8_bpe", "op7_quality", "op10_toxicity"):  # each row by its own text
        results, texts = defaultdict(set), defaultdict(set)
        for r in got:
            results[r.doc_id].add(tuple(v for c, v in r.asDict().items() if c != "doc_id"))
        for r in rows():
            texts[r[0]].add(r[1])
        assert all(len(results[i]) <= len(texts[i]) for i in texts)
