"""The screen of the line dedup: lines that share a passage stop there, near copies never do."""

import random

from millrace.llm import line_dedup


def dedup(spark, monkeypatch, lines):
    """Numbers of the lines that pass the screen, and of those that go."""
    passed = []
    line_sets = line_dedup.line_sets

    def noted(documents, places):
        passed.extend(r.doc_id for r in places.collect())
        return line_sets(documents, places)

    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "line_sets", noted)
        gone = {r.doc_id for r in line_dedup.removals(docs).collect()}
    return set(passed), gone


def test_lines_with_one_common_shingle_stop_at_the_screen(spark, monkeypatch):
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passages = [words(5) for _ in range(20)]  # some come early in the order of the prefixes, some late
    lines = [" ".join(words(20) + passages[i % 20] + words(20)) for i in range(200)]
    near = lines[7] + " end"
    passed, gone = dedup(spark, monkeypatch, [*lines, near])
    assert gone == {200}
    assert passed == {7, 200}


def test_screen_loses_no_partner_of_any_length(spark, monkeypatch):
    rnd = random.Random(6)
    lines = []
    for n in [*range(1, 40), 60, 90] * 3:
        base = [f"v{rnd.randrange(10**9)}" for _ in range(n)]
        if n % 3 == 0:  # repeated words: fewer pairs than shingles
            base = [rnd.choice(base[:4]) for _ in base]
        other = list(base)
        for _ in range(rnd.randrange(3)):
            other[rnd.choice((0, -1))] = f"x{rnd.randrange(10**9)}"
        lines += [" ".join(base), " ".join(other) + " " * rnd.randrange(2)]

    def tokens(line):
        w = line.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [tokens(x) for x in lines]
    want = {j for j in range(len(lines)) if any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(j))}
    _, gone = dedup(spark, monkeypatch, lines)
    assert gone == want and len(want) > 40
