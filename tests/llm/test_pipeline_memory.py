"""What the pipeline's stages leave to the memory of the stages after them."""

import corpus_pipeline as cp
from millrace.llm import bpe


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())


def test_bpe_begins_with_a_collected_heap_and_small_batches(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def sizes(documents, *_):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

        return documents.mapInArrow(run, "n long")

    with monkeypatch.context() as m:
        m.setattr(bpe, "encode_documents", sizes)
        before = full_collections(spark)
        got = [r.n for r in cp.bpe_round_trip(spark, docs, "").collect()]
    assert full_collections(spark) > before
    assert sum(got) == 5000 and max(got) <= 1000
    assert cp.bpe_round_trip(spark, docs, "").count() == 5000
