import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, removed string"


def brute(rows):
    """Places of later matches per document, by comparing every line with every earlier one."""
    index, sets, out = defaultdict(list), [], {}
    for i, text in rows:
        gone = []
        for at, line in enumerate((text or "").split("\n")):
            w = line.lower().split()
            if not w:
                continue
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
            shared = Counter(q for g in s for q in index[g])
            if any(100 * n >= 80 * (len(s) + len(sets[q]) - n) for q, n in shared.items()):
                gone.append(at)
            for g in s:
                index[g].append(len(sets))
            sets.append(s)
        out[i] = gone
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    line = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, bases = line(15), [line(n) for n in (5, 6, 8, 9, 12, 20, 40, 80, 200) for _ in range(2)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 8)):
            kind = rnd.random()
            if kind < 0.5:
                copy = list(rnd.choice(bases))
                for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                    copy[rnd.randrange(len(copy))] = rnd.choice(words)
                if rnd.random() < 0.2:
                    copy += copy[: rnd.randrange(len(copy))]
                lines.append(rnd.choice([" ", " ", "  ", "\t"]).join(copy))
            elif kind < 0.7:
                lines.append(" ".join(line(rnd.randint(2, 40)) + passage + line(rnd.randint(2, 40))))
            else:
                lines.append(rnd.choice(["", " ", "A b", " ".join(line(rnd.randint(1, 30))).upper()]))
        docs.append((i, "\n".join(lines)))
    return [*docs, (60, None), (61, ""), (62, "one two three four five\nONE two  three four five\t\none two three four")]


@pytest.mark.parametrize(("seed", "hot", "broadcast"), [(1, 8, 400_000), (2, 2, 20), (3, 1, 1), (4, 1, 20)])
def test_matches_brute_force(spark, monkeypatch, seed, hot, broadcast):
    monkeypatch.setattr(ld, "HOT", hot)
    monkeypatch.setattr(ld, "BROADCAST_ROWS", broadcast)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    got = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    assert {i: r["__removed"] or [] for i, r in got.items()} == want
    for i, text in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])
        assert got[i].text == kept


def test_columns_pass_through_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e", "x"), (1, "a b c d e\nz", "y"), (1, "a b c d e\nz", "y")], SCHEMA)
    got = sorted((str(r.doc_id), r.text, r.removed) for r in ld.dedup_lines(df).collect())
    assert got == [("1", "z", "y"), ("1", "z", "y"), ("None", "a b c d e", "x")]
    assert ld.dedup_lines(df.limit(0)).collect() == []


def test_sets_of_one_shingle_match_in_frequent_buckets(spark):
    """20 lengths of one repeated word have equal sets of one shingle and different keys; longer lines share it too."""
    rows = [(i, "\n".join(w + f" {w}" * (4 + i) for w in ("-", "ha"))) for i in range(20)]
    rows += [(20 + i, f"- - - - - a{i} b{i} c{i}\na{i} b{i} c{i} - - - - -") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r["__removed"] or [] for r in ld.dedup_lines(df).collect()}
    assert got == brute(rows)
    assert all(got[i] == [0, 1] for i in range(1, 20)) and got[0] == []


def test_near_copies_of_one_line_meet_through_their_hub(spark, monkeypatch):
    """A crowd near the threshold: most lines match some earlier one, though few match the first."""
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rnd.choice([1, 1, 2, 2, 3, 4])):
            copy[rnd.choice([3, 11, 20, 31, 42, 50, 60, 66])] = rnd.choice(["x", "y", f"z{i}"])
        del copy[: rnd.choice([0, 0, 0, 1, 5])]
        rows.append((i, " ".join(copy)))
    for hot in (1, 8):
        monkeypatch.setattr(ld, "HOT", hot)
        got = {r.doc_id: r["__removed"] or [] for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows)


def test_rows_of_one_id_with_other_texts_are_apart(spark):
    rows = [(0, "a b c d e"), (1, "a b c d e"), (1, "q r s t u"), (None, "q r s t v"), (None, None), (2, "Read more"), (3, "x\nread  MORE")]
    got = sorted((str(r.doc_id), str(r.text)) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("0", "a b c d e"), ("1", ""), ("1", "q r s t u"), ("2", "Read more"), ("3", "x"), ("None", "None"), ("None", "q r s t v")]


def test_clashing_names_and_very_long_lines(spark):
    names = "doc_id long, text string, row string, th string, removed string, key string, id string, at string, `a.b` string, __removed string"
    text = " ".join(f"v{i % 977}x{i % 1009}" for i in range(60_000))
    rows = [(i, text + tail, *"abcdefgh") for i, tail in enumerate(("", " end", "\n" + text))]
    df = spark.createDataFrame(rows, names)
    out = ld.dedup_lines(df, "gone")
    assert out.columns == [*df.columns, "gone"]
    assert [(r.text, r.row, r["a.b"], r.gone) for r in out.orderBy("doc_id").collect()] == [
        (text, "a", "g", None), ("", "a", "g", [0]), ("", "a", "g", [0, 1])
    ]
    assert ld.dedup_lines(df).columns == df.columns
