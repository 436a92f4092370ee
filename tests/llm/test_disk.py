"""What stages of the pipeline write and shuffle besides their result."""

import os
import random

import pytest

from meshlake.llm import line_dedup, quality, simhash
from meshlake.llm.filters import bitmap_filter, maybe_in, surely_out
from meshlake.runtime import shared_dir

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


@pytest.fixture(scope="module")
def long_docs(spark):
    """240 texts that hardly compress; every twelfth shares a line, is a near copy of the one before, or is repetitive."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices(LETTERS, k=rng.randint(5, 9)))
    rows = []
    for k in range(240):
        words = [word() for _ in range(700)]
        if k % 12 == 1:
            words = rows[-1][1].split(" ")
            words[5] = word()
        text = " ".join(words)
        if k % 12 == 5:
            text += "\none line that all sources share"
        if k % 12 == 9:
            text = " ".join(words[:20] * 35)
        rows.append((k, text, "en", f"s{k // 12}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


def shuffled_bytes(spark, run):
    """Bytes that the stages of run() wrote for shuffles, where joins of all sizes are made by shuffle."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = spark._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = total()
        run()
        return sum(v for k, v in total().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def n_bytes(docs):
    return sum(len(r.text) for r in docs.collect())


def test_quality_writes_no_texts(spark, long_docs):
    def held():
        return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(shared_dir(spark).removeprefix("file:")) for f in names}

    before = held()
    kept = quality.keep_good(long_docs).count()
    assert kept == 220
    assert sum(v for k, v in held().items() if k not in before) < n_bytes(long_docs) / 4


def test_quality_shuffles_only_what_may_go(spark, long_docs):
    out = []
    shuffled_bytes(spark, lambda: out.append(quality.keep_good(long_docs)))
    assert shuffled_bytes(spark, lambda: out[0].write.format("noop").mode("overwrite").save()) < n_bytes(long_docs) / 4


def test_line_dedup_shuffles_only_what_may_lose_a_line(spark, long_docs):
    run = lambda: line_dedup.line_dedup(long_docs, min_sites=15).write.format("noop").mode("overwrite").save()
    assert shuffled_bytes(spark, run) < n_bytes(long_docs) / 4
    assert sum(r.n_removed for r in line_dedup.line_dedup(long_docs, min_sites=15).collect()) == 19


def test_near_copies_shuffle_only_texts_that_may_go(spark, long_docs):
    """Keys and sets of hashes are shuffled; whole texts are not."""
    out = []
    made = shuffled_bytes(spark, lambda: out.append(simhash.keep_one(long_docs)))
    assert made > 0
    assert shuffled_bytes(spark, lambda: out[0].write.format("noop").mode("overwrite").save()) < n_bytes(long_docs) / 4
    assert out[0].count() == 220


def test_sides_of_a_filter_make_the_whole(spark):
    keys = spark.range(0, 30_000, 3).selectExpr("xxhash64(id) as h")
    rows = spark.range(30_000).selectExpr("id", "if(id % 100 = 7, null, xxhash64(id)) as h")
    for bits in (1 << 15, 1 << 18):
        held = bitmap_filter(keys, "h", bits)
        some, rest = ({r.id for r in f(rows, held, rows["h"], bits).collect()} for f in (maybe_in, surely_out))
        assert not some & rest and {i for i in range(0, 30_000, 3) if i % 100 != 7} <= some
        assert some | rest == set(range(30_000))
