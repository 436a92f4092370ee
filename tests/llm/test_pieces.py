import itertools
import random

import pytest
import sentencepiece

from meshlake.llm import lattice, pieces, token_counts

MODEL = pieces.default_model()


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(seed, n, most=12):
    rng = random.Random(seed)
    names = list(pieces.vocabulary(MODEL).ids)
    parts = [lambda: rng.choice(names).replace("▁", " "), lambda: rng.choice("ab e\n\t 日本é▁\0𝒳<s>0x"), lambda: rng.choice(["aaaa", "  ", "    ", "\r\n", "the", "</s>"])]
    return ["".join(rng.choice(parts)() for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_counts_equal_the_library(processor):
    counter = token_counts.transducer(MODEL)
    for text in [*texts(1, 3000), "ab" * 50_000 + " " + "z" * 9000, "\n" * 3000, " " * 3000]:
        assert counter.count(text) == len(processor.encode(text)), repr(text[:80])


def test_chunk_maps_compose(processor):
    counter = token_counts.transducer(MODEL)
    for k, text in enumerate(texts(2, 300, 30)):
        assert counter.count(text, chunk=k % 11 + 1) == len(processor.encode(text))


def test_tables_start_afresh_within_their_bounds(processor, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "MOST_UNITS", 5)
    counter = token_counts.Transducer(pieces.vocabulary(MODEL))
    for text in texts(3, 150, 20):
        assert counter.count(text) == len(processor.encode(text))
        assert len(counter.states) <= 51 and len(counter.units) <= 5


def test_count_documents(spark):
    rows = [(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (None, "x " * 5000, "d"), (1, "Hello world", "a")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted([(r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got]) == [(0, 10000, 5001, True), (1, 11, 2, False), (1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False)]
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def all_paths(own, unit):
    """Every segmentation of a unit with its score."""
    if not unit:
        return [(0, ())]
    out = []
    for start, (score, ids) in own.into(unit, len(unit)):
        out += [(s + score, p + ids) for s, p in all_paths(own, unit[:start])]
    return out


def test_n_best_equals_brute_force():
    own = lattice.Segmenter(pieces.vocabulary(MODEL), 4)
    rng = random.Random(5)
    for _ in range(200):
        unit = "".join(rng.choices("▁theranins日𝒳", k=rng.randint(1, 9)))
        every = sorted((s for s, _ in all_paths(own, unit)), reverse=True)[:4]
        assert [s for s, _ in own.n_paths(unit)] == every
        assert own.forward(unit)[-1] == every[0]


def test_long_units_hold_little(monkeypatch):
    own = lattice.Segmenter(pieces.vocabulary(MODEL), 3)
    rng = random.Random(9)
    units = ["".join(rng.choices("theranins日", k=rng.randint(20, 60))) for _ in range(50)]
    whole = [own.n_paths(u) for u in units]
    monkeypatch.setattr(lattice, "LONG_UNIT", 4)
    assert [[s for s, _ in own.n_paths(u)] for u in units] == [[s for s, _ in p] for p in whole]
    assert len(own.encode("x" * 100_000)[2]) == 3


def test_n_best_of_a_text_combines_units():
    own = lattice.Segmenter(pieces.vocabulary(MODEL), 3)
    for text in texts(6, 60, 4):
        units = own.vocab.units(own.vocab.normalize(text))
        sums = sorted((sum(x) for x in itertools.product(*[[s for s, _ in own.n_paths(u)] for u in units])), reverse=True)[:3] if len(units) < 7 else None
        _, ids, scores = own.encode(text)
        if sums is not None:
            assert scores == [x / pieces.MILLION for x in sums]
        listed = own.n_encodings(text)
        assert [s / pieces.MILLION for s, _ in listed] == scores
        for _, path in listed:
            assert lattice.decode(own.vocab, path) == text.replace("▁", " ")


def test_round_trip_and_library_decoding(processor):
    own = lattice.Segmenter(pieces.vocabulary(MODEL), 2)
    for text in [*texts(7, 1500), "x" * 5000, "日" * 300]:
        library, ids, _ = own.encode(text)
        assert lattice.decode(own.vocab, ids.tolist()) == text.replace("▁", " ")
        assert processor.decode(ids.tolist()) == text.replace("▁", " ")
        theirs = processor.encode(text)
        assert library.tolist() == theirs
        assert lattice.decode(own.vocab, theirs) == text.replace("▁", " ")


def test_encode_documents(spark):
    rows = [(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (None, "day " * 5000, "d"), (1, "Hello world", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = lattice.encode_documents(docs, ["doc_id"], n_best=2)
    got = sorted(encoded.collect(), key=lambda r: (r.doc_id or 0, r.n_pieces))
    assert [(r.doc_id, r.n_pieces) for r in got][1:] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert got[3].scores == [0.0] and got[3].ids == []
    back = {(r.doc_id or 0): r.text for r in lattice.decode_documents(encoded, ["doc_id"]).collect()}
    assert back == {0: "day " * 5000, 1: "Hello world", 2: "", 3: ""}
    assert lattice.encode_documents(docs.limit(0), ["doc_id"]).collect() == []
    named = lattice.encode_documents(docs.withColumn("n_pieces", docs["doc_id"]).withColumn("scores", docs["text"]), ["doc_id", "n_pieces", "scores", "ids"], paths=False)
    assert named.columns == ["doc_id", "ids", "n_pieces", "scores"] and named.count() == 5


def test_query(spark, docs, rows, tmp_path, processor):
    """Every column of the query by the library, and by the lattice of whole texts."""
    from pyspark.sql import functions as F

    from meshlake.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, str(tmp_path)).collect()}
    own = lattice.Segmenter(pieces.vocabulary(MODEL), queries.N_BEST)
    whole = [(processor.encode(text or ""), own.n_encodings(text)) for _, text, *_ in rows]
    hashed = spark.createDataFrame([(k, theirs, best[0][1]) for k, (theirs, best) in enumerate(whole)], "k int, a array<int>, b array<int>")
    hashes = {r.k: (r.a, r.b) for r in hashed.select("k", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).collect()}
    for k, ((doc_id, *_), (theirs, best)) in enumerate(zip(rows, whole, strict=True)):
        r = got[doc_id]
        assert (r.n_pieces, r.ids_hash, r.round_trip) == (len(theirs), hashes[k][0], True)
        assert r.scores == [s / pieces.MILLION for s, _ in best] and r.score == r.scores[0]
        assert (r.n_lattice, r.lattice_hash) == (len(best[0][1]), hashes[k][1])


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_units_walked_together_equal_the_search(n):
    own = lattice.Segmenter(pieces.vocabulary(MODEL), n)
    rng = random.Random(n)
    units = ["".join(rng.choices("▁theranins日𝒳é", k=rng.randint(1, 9))) for _ in range(300)]
    units += [u for text in texts(8, 400) for u in own.vocab.units(own.vocab.normalize(text))] + ["▁" + "the" * 40, "a" * 64, "a" * 65]
    units = list(dict.fromkeys(units))
    numbers = [own.solved[u] for u in units]
    own.solved.learn()
    assert numbers == [own.solved[u] for u in units]
    walked = 0
    for u in units:
        walked += own.walk.known(own.walk.letters([u])).all()
        k, paths = own.solved[u], own.n_paths(u)
        lost = own.solved.losses[k * (n - 1) : (k + 1) * (n - 1)].tolist()
        assert (own.solved.score[k], [x for x in lost if x != lattice.NEVER]) == (paths[0][0], [paths[0][0] - p[0] for p in paths[1:]])
        start, size = own.solved.lattice[0][k], own.solved.lattice[1][k]
        assert tuple(own.solved.ids[start : start + size]) == paths[0][1]
        start, size = own.solved.library[0][k], own.solved.library[1][k]
        assert own.solved.ids[start : start + size].tolist() == own.vocab.merged(u)
    assert 100 < walked < len(units)


def test_query_asks_for_more_than_the_second_best():
    """The least loss alone gives the second best; a third needs the sums of several."""
    from meshlake.llm import queries

    assert queries.N_BEST >= 3


def test_query_takes_one_worker_a_task(spark, docs, tmp_path):
    """Each pass of a stage takes a worker of its own from one pool, and in time all of them hold a segmenter."""
    from meshlake.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op4_sentencepiece(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_decoding_in_the_same_pass(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "日本 \0𝒳é " * 400), (1, "▁a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    encoded = lattice.encode_documents(docs, ["doc_id"], paths=False, decoded="back")
    assert encoded.columns == ["doc_id", "ids", "n_pieces", "scores", "back"]
    assert [r.back for r in encoded.collect()] == [(t or "").replace("▁", " ") for _, t in rows]
    assert [r.text for r in lattice.decode_documents(encoded, ["doc_id"]).collect()] == [r.back for r in encoded.collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_all_n_best_segmentations_are_whole(n, monkeypatch):
    """Not only the scores: each of the n best of a text with its identifiers, equal ones in one order."""
    own = lattice.Segmenter(pieces.vocabulary(MODEL), n)
    some = [*texts(10, 200), None, "", "the the the then the", "a" * 70 + " " + "ab" * 40, "day " * 300, "日本 \0𝒳é " * 40]
    for length in (lattice.LONG_UNIT, 3):
        # short units are searched side by side, others alone
        monkeypatch.setattr(lattice, "LONG_UNIT", length)
        own.solved.renew()
        for text, (library, best, following, scores) in zip(some, own.encode_all(some), strict=True):
            paths = [best, *[lattice.spliced(best, x) for x in following]]
            listed = own.n_encodings(text)
            assert scores == [s / pieces.MILLION for s, _ in listed]
            assert [p.tolist() for p in paths] == [p for _, p in listed]
            assert len({tuple(p.tolist()) for p in paths}) == len(paths)
            assert library.tolist() == own.vocab.processor.encode(text or "")
            for p in paths:
                assert lattice.decode(own.vocab, p.tolist()) == (text or "").replace("▁", " ")


def test_paths_outlast_the_next_slice():
    own = lattice.Segmenter(pieces.vocabulary(MODEL), 3)
    held = [(t, made) for k in range(5) for t in [texts(20 + k, 40)] for made in [own.encode_all(t)]]
    for some, made in held:
        for text, (_, best, following, _) in zip(some, made, strict=True):
            assert [lattice.decode(own.vocab, lattice.spliced(best, x).tolist()) for x in following] == [text.replace("▁", " ")] * len(following)


def test_every_unit_is_searched_backward():
    """Side by side or alone, equal paths too come in the order of the search."""
    own = lattice.Segmenter(pieces.vocabulary(MODEL), 5)
    rng = random.Random(12)
    units = list(dict.fromkeys("".join(rng.choices("▁thearinsaaab", k=rng.randint(1, 14))) for _ in range(400)))
    numbers = [own.solved[u] for u in units]
    own.solved.learn()
    for k, u in zip(numbers, units, strict=True):
        paths = own.n_paths(u)
        assert [tuple(own.solved.path(k, c).tolist()) for c in range(len(paths))] == [p for _, p in paths]


def test_query_keeps_the_next_segmentations(spark, docs, rows, tmp_path):
    from pyspark.sql import functions as F

    from meshlake.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, str(tmp_path)).collect()}
    whole = {r.doc_id: r for r in lattice.encode_documents(docs, ["doc_id"], n_best=queries.N_BEST).collect()}
    own = lattice.Segmenter(pieces.vocabulary(MODEL), queries.N_BEST)
    listed = {doc_id: [p for _, p in own.n_encodings(text)] for doc_id, text, *_ in rows}
    hashed = spark.createDataFrame([(d, k, p) for d, paths in listed.items() for k, p in enumerate(paths)], "d long, k int, p array<int>")
    hashes = {(r.d, r.k): r.h for r in hashed.select("d", "k", F.xxhash64("p").alias("h")).collect()}
    assert max(map(len, listed.values())) == queries.N_BEST
    for doc_id, paths in listed.items():
        assert [whole[doc_id].lattice_ids, *whole[doc_id].next_ids] == paths
        assert got[doc_id].next_sizes == [len(p) for p in paths[1:]]
        assert got[doc_id].next_hashes == [hashes[doc_id, k] for k in range(1, len(paths))]
