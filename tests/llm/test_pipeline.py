from collections import Counter

import sentencepiece
from test_dedup import brute_lines
from test_near_copies import kept_by_brute_force
from test_quality_and_urls import verdicts

import corpus_pipeline
from meshlake.llm import lattice, queries
from meshlake.llm.pieces import default_model, vocabulary


def test_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet").drop("extra")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, current = current, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, current)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert current.columns == corpus_pipeline.COLUMNS
    by_text = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    last = 10**9  # a null identifier comes last
    number = lambda r: last if r.doc_id is None else r.doc_id
    ids = lambda df: sorted(map(number, df.select("doc_id").collect()))
    before, after = seen["quality rules"]
    told = [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()]
    assert by_text(after) == Counter((r[0], r[1]) for r, (kept, _) in zip(told, verdicts(told, corpus_pipeline.MIN_WORDS), strict=True) if kept)
    before, after = seen["line dedup"]
    told = [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()]
    assert by_text(after) == Counter((r[0], r[1]) for r in brute_lines(told, queries.MIN_SITES))
    before, after = seen["SimHash near-dedup"]
    want, _ = kept_by_brute_force([(number(r), r.text) for r in before.collect()])
    assert ids(after) == sorted(want) and len(ids(after)) < len(ids(before))
    before, after = seen["mixing sources to target weights"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).count(i) for i in set(ids(after))) <= 2
    before, after = seen["SentencePiece encoding and decoding"]
    texts = {r.doc_id: r.text for r in before.collect()}
    vocab = vocabulary(default_model())
    assert ids(before) == ids(after)
    processor = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for r in after.collect():
        assert r.ids == processor.encode(texts[r.doc_id])
        assert lattice.decode(vocab, r.ids) == texts[r.doc_id] and r.n_pieces == len(r.ids)
