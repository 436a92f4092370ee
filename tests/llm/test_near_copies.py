import glob
import math
import random
import time

from meshlake.llm import simhash


def shingles(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def kept_by_brute_force(rows):
    """The smallest doc_id of each component of texts at Jaccard 0.8 or more."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    below = 0
    for a in sets:
        for b in sets:
            if a < b:
                both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if sets[a] == sets[b] or 5 * both >= 4 * either:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
                elif 5 * both >= 3 * either:
                    below += 1
    return {d for d in sets if root[d] == d}, below


def texts(seed, edits):
    """Pairs of texts that differ in single words."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(4000)]
    rows = []
    for k in range(100):
        base = rng.choices(words, k=rng.randint(150, 300))
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.choice(edits)):
            copy[at] = rng.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    return rows


def test_no_text_below_the_share_is_dropped(spark):
    rows = texts(3, range(4, 14))
    want, below = kept_by_brute_force(rows)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert below > 20 and len(want) < 200 and want <= kept


def test_no_near_copy_is_missed(spark):
    rows = texts(4, range(2, 7))
    want, _ = kept_by_brute_force(rows)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(want) < 150 and kept == want


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(4000)]
    base = rng.choices(words, k=200)
    rows = [(1000 + k, " ".join(rng.choices(words, k=100) + base[:40])) for k in range(20)]
    for k in range(300):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    want, _ = kept_by_brute_force(rows)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == want


def plans(spark, run):
    """The plans that Spark ran for run()."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(found.size()) if found.apply(i).executionId() not in before]


def test_no_exploded_index_is_broadcast(spark):
    """An index has 66 keys a fingerprint, of which the planner's estimate knows nothing."""
    rng = random.Random(6)
    fps = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(300)], "fp long")
    made = plans(spark, lambda: simhash.near_components(fps).collect())
    exploded = [p for p in made if "Generate" in p]
    assert exploded and not any("BroadcastExchange" in p for p in exploded), next(p[:3000] for p in exploded if "BroadcastExchange" in p)


def test_no_index_of_sets_is_broadcast(spark):
    from meshlake.runtime import materialize

    sizes = materialize(spark.range(300).selectExpr("id as sid", "xxhash64(id) as fp"), "sizes")
    plan = simhash.head_pairs(sizes, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_common_shingles_are_counted_over_all_rows(spark):
    """More rows than any sample held: the count is that of every row."""
    n = 70_000
    docs = spark.range(n).selectExpr("concat('a b c d e w', id) as text")
    cell = int(simhash.shingle_hashes("a b c d e", 5)[0]) % simhash.CELLS
    assert simhash.common_cells(docs, 5)[cell] in (round(1000 * math.log2(n + k)) for k in range(4))


def test_shingles_are_told_apart_by_words_and_their_order():
    rng = random.Random(8)
    made = ["", " ", "A a", "a A a a a a", "a b c d e", "b a c d e", "ab c d e", "abc d e", "a b c d", *(" ".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(3000))]
    seen = {}
    for text in made:
        parts, hashes = shingles(text), simhash.shingle_hashes(text, 5)
        assert len(hashes) == len(parts)
        assert seen.setdefault(hashes.tobytes(), parts) == parts


def test_written_tables_leave_no_shuffle_files(spark):
    from meshlake.runtime import materialize

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    before = held()
    dealt = materialize(spark.range(20_000).repartition(3, "id"), "dealt")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert dealt.count() == 20_000
