import re
from collections import Counter

from meshlake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def filled(sizes, weights, budget, epochs):
    """Water-filling by hand: clamp, share again."""
    clamped = {}
    while True:
        left = budget - sum(clamped.values())
        open_ = {s: w for s, w in weights.items() if s not in clamped}
        total = sum(open_.values())
        share = {s: w * left / total for s, w in open_.items()} if total else {s: 0.0 for s in open_}
        above = [s for s in share if share[s] > epochs * sizes[s]]
        if not above:
            return clamped | share
        clamped |= {s: epochs * float(sizes[s]) for s in above}


def test_mix(spark, docs, rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    order = sorted([s for s in sizes if s is not None]) + [None]
    weights = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    for digits in (3, 1):
        got = mixing.mix(docs, cycle=[5, 2, 1], digits=digits).collect()
        assert len(got) == len(rows)
        taken = {}
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.copies <= 2
            taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        largest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in sizes}
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = mixing.mix(docs.repartition(7), cycle=[5, 2, 1]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_repeat_rows(docs, rows):
    mixed = mixing.mix(docs, cycle=[5, 2, 1])
    out = mixing.repeat_rows(docs, cycle=[5, 2, 1])
    assert out.columns == docs.columns
    count = lambda found: Counter(x for r, n in found for x in [r] * n)
    assert count((r.doc_id, 1) for r in out.collect()) == count((r.doc_id, r.copies) for r in mixed.collect())


def test_repeat_rows_with_clashing_names(spark):
    names = ["doc_id", "text", "source", "copies", "h", "row", "__k", "__size", "__copy", "cut", "size"]
    rows = [(i if i % 3 else None, "w " * (i % 7), "ab"[i % 2], *range(8)) for i in range(60)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "string", "string"] + ["int"] * 8, strict=True)))
    out = mixing.repeat_rows(docs, cycle=[5, 2])
    assert out.columns == names and set(map(tuple, out.collect())) <= set(rows)
    assert mixing.repeat_rows(docs.limit(0), cycle=[1]).collect() == []


def test_no_copies_beyond_the_epochs(spark):
    """Wordless documents are not taken a third time by a source at its cap."""
    docs = spark.createDataFrame([(i, "w w" if i > 4 else None, "a") for i in range(10)] + [(10 + i, "w " * 50, "b") for i in range(10)], "doc_id long, text string, source string")
    for seed in range(4):
        assert max(r.copies for r in mixing.mix(docs, cycle=[5, 1], seed=seed).collect()) <= 2


def test_empty_and_wordless(spark, none):
    assert mixing.mix(none, cycle=[1]).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id int, text string, source string")).collect()
    assert [(r["size"], r.target, r.copies) for r in got] == [(0, 0.0, 0)] * 2


def test_weights_as_a_table(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0)], "source string, weight double")
    got = {r.source: r.target for r in mixing.mix(docs, weights=weights, share=0.8).collect()}
    assert got == {"a": 600.0, "b": 200.0}
