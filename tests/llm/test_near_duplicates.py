import random

import pytest

from millrace.llm import near_duplicates as nd

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, rows = text(40), []
    for n in (1, 4, 5, 6, 8, 12, 30, 100, 100, 400):
        base = text(n)
        for _ in range(rnd.randint(5, 20)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, n // 60, n // 40, n // 25])):
                at = rnd.randrange(len(copy))
                what = rnd.random()
                copy[at : at + 1] = [] if what < 0.3 and len(copy) > 1 else [rnd.choice(words)] * (1 if what < 0.7 else 2)
            rows.append(" ".join(copy))
    rows += [" ".join(text(k) + passage + text(k)) for k in (5, 10, 20, 30, 40, 60, 80, 100) for _ in range(5)]
    rows += [None, "", " \t\n", "One", "one", rows[3], rows[3].upper(), " ".join(text(30_000))]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, 32, 12_000_000), (2, 2, 12_000_000), (3, 2, 2_000)])
def test_components_match_brute_force(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(nd, "HOT", hot)
    monkeypatch.setattr(nd, "BLOCK_CHARS", block)
    rows = corpus(seed)
    got = nd.near_duplicate_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_null_ids_clashing_columns_and_empty_tables(spark):
    rows = [(None, "a b c d e f g", "x"), (5, "a b c d e f g", "y"), (9, "A b c d e f  g", None), (9, "A b c d e f  g", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", key string")
    got = sorted(nd.near_duplicate_components(df).collect(), key=str)
    assert sorted(str(r.component_id) for r in got) == ["5", "5", "5", "None"]
    assert nd.near_duplicate_components(df.limit(0)).collect() == []
    assert nd.near_duplicate_components(df.select("doc_id", "text").where("false")).count() == 0


def test_rounds_over_few_rows_start_few_tasks(spark, monkeypatch):
    partitions, joined = [], nd.connected_components
    monkeypatch.setattr(nd, "connected_components", lambda links: partitions.append(links.rdd.getNumPartitions()) or joined(links))
    monkeypatch.setattr(nd, "HOT", 2)
    rows, conf = corpus(2), {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = nd.near_duplicate_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(partitions) > 1 and max(partitions) <= 3 * spark.sparkContext.defaultParallelism
