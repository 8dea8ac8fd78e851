"""Quality rules and decontamination against plain Python over awkward rows."""

import random
import re
from collections import defaultdict

from millrace.llm import decontamination as dc
from millrace.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "b", "Zé", "x|y", "##", "ÉT", "don't", "0", " q"]
    out = [None, "", " \t\n", "\n\n", "one", "a " * 8, "a " * 7, "a b " * 50, "漢字 " * 30, "w" * 5000, "line one is here\n" * 9]
    for _ in range(n):
        sep = lambda: rnd.choice([" ", " ", " ", "  ", "\n", "\t", "\x0b"])
        out.append("".join(rnd.choice(words) + sep() for _ in range(rnd.randint(1, 80))))
    return [*out, out[20], out[20], " ".join(rnd.choice(words) + str(i % 997) for i in range(40_000))]


def measures(text):
    w = WORD.findall(text or "")
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rules(spark):
    rows = [(i, t, f"h{i % 3}", 7) for i, t in enumerate(texts(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")
    got = {r.doc_id: r for r in qr.apply_rules(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want, r = measures(text), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert qr.apply_rules(df.limit(0)).collect() == []


def test_hosts_are_judged_by_shrunken_rates(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "bad " * 40, "spam") for i in range(200)] + [(200, clean, "spam")]
    rows += [(1000 + i, clean, f"good{i % 20}") for i in range(400)] + [(2000, "bad " * 40, "tiny"), (2001, clean, None)]
    got = {r.doc_id: r for r in qr.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[200].kept and got[200].host_failed and not got[200].base_failed
    assert all(got[1000 + i].kept for i in range(400)) and got[2001].kept
    assert not got[2000].host_failed  # one document is no evidence against its host


def test_decontamination(spark):
    rnd = random.Random(4)
    docs = texts(2)
    bench = [None, "", "...", "don't 0", "alpha", " ".join(f"tok{i}" for i in range(25)), "a b " * 12, docs[30], docs[30]]
    docs += ["x " * 5 + " ".join(f"TOK{i}" for i in range(3, 17)) + " y", "say ALPHA now", " ".join(f"tok{i}" for i in range(9))]
    docs = [(i, t) for i, t in enumerate(docs)] + [(None, "alpha"), (0, None), (5, docs[5]), (5, docs[5])]
    items = list(enumerate(bench))
    rnd.shuffle(items)
    D = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit")
    B = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(str(i))

    def want(t):
        w, hit, ids = words(t), set(), set()
        for size in {len(g) for g in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    ids |= found
        return len(w), len(hit), ",".join(sorted(ids))

    import pyspark.sql.functions as F

    for limit in (500_000, 0):  # broadcast and shuffled
        old, dc.BROADCAST_WINDOWS = dc.BROADCAST_WINDOWS, limit
        rows = dc.hits(D, B).select("doc_id", "n_words", dc.n_hit(F.col("found")), F.array_join(dc.item_ids(F.col("found")), ","), dc.hit_spans(F.col("found"))).collect()
        dc.BROADCAST_WINDOWS = old
        assert sorted((str(r[0]), *r[1:4]) for r in rows) == sorted((str(i), *want(t)) for i, t in docs)
        assert all(r[2] == sum(s["last"] - s["first"] + 1 for s in r[4]) for r in rows)
    kept = {r.doc_id for r in dc.remove_contaminated(D, B).collect()}
    assert kept == {i for i, t in docs if not want(t)[1]}
    assert all(r[1] == 0 for r in dc.hits(D, B.limit(0)).select("doc_id", dc.n_hit(F.col("found"))).collect())
    assert dc.hits(D.limit(0), B).collect() == []
