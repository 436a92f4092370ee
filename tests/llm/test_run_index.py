import hashlib
import random
from collections import Counter

import pytest

from meshlake.llm import run_index as ri


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij é", k=rng.randint(2, 9))) for _ in range(50)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    shared = [text(20) for _ in range(4)]
    docs = []
    for _ in range(n):
        parts = [text(rng.randint(0, 40)) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.6:
            p = rng.choice(shared)
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)])
        docs.append(" ".join(parts))
    return docs + [docs[3], docs[3][:-1] + "!", None, "", "x" * 500, "ab" * 300, "y" * 39, "z" * 40, "z" * 41, docs[5] + docs[5]]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_equals_brute_force(spark, block):
    texts = passages(1)
    rows = [(i if i != 7 else None, t, "k", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string, g int").repartition(5)
    got = ri.repeated_passages(docs, least=40, kmer=12, block=block).collect()
    want = brute(texts, 40)
    assert len(got) == len(texts)
    for r in got:
        i = 7 if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) == want[i], i


def test_empty_table(spark):
    assert ri.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_statistics():
    parts = [b"abracadabra", b"xxabracadyy", b"q"]
    index = ri.RunIndex(parts)
    whole = b"\0".join(parts) + b"\0"
    samples = {p: (q, n) for chunk in index.statistics() for p, q, n in zip(*(x.tolist() for x in chunk), strict=True)}
    for p, (q, n) in samples.items():
        assert whole[p : p + n] == whole[q : q + n]
    part, s, e = index.marks(7)
    assert list(zip(part.tolist(), s.tolist(), e.tolist(), strict=True)) == [(0, 0, 7), (1, 2, 9)]


def test_contexts_do_not_depend_on_steps(monkeypatch):
    own = ri.Anchors(40, 12)
    data = random.Random(2).randbytes(3000)
    monkeypatch.setattr(ri, "STEP", 97)
    starts, lengths, anchors = own.contexts(data)
    assert sum((lengths - 39).tolist()) == 3000 - 39
    monkeypatch.undo()
    assert set(own.contexts(data)[2].tolist()) == set(anchors.tolist())


def test_hot_anchor_and_short_period(spark):
    """More than 10,000 contexts of one anchor, some of which share a window; 2 MB of one letter."""
    rng = random.Random(7)
    core = "q" * 3 + "".join(rng.choices("abcdefgh", k=24))
    noise = lambda k: "".join(rng.choices("ijklmnopqrstuvwxyz", k=k))
    sides = [(noise(30), noise(30)) for _ in range(300)]
    texts = []
    for _ in range(10_500):
        left, right = noise(30), noise(30)
        if rng.random() < 0.05:
            left = left[:10] + rng.choice(sides)[0][10:]
        if rng.random() < 0.05:
            right = rng.choice(sides)[1][:20] + right[20:]
        texts.append(left + core + right)
    texts += ["a" * 2_000_000, "b" * 39, "xy" * 300, "xyz" + "a" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ri.repeated_passages(docs, least=40, kmer=12, block=1 << 16).collect()}
    long = len(texts) - 4
    want = brute(texts[:long] + texts[long + 1 :], 40)
    assert sum(1 for w in want if w[1]) > 200
    for i in range(len(texts)):
        if i != long:
            assert (got[i].n_bytes, got[i].n_removed, len(got[i].starts), got[i].kept_sha256) == want[i if i < long else i - 1] or i == long + 3, i
    assert (got[long].n_removed, got[long].starts, got[long].ends) == (2_000_000, [0], [2_000_000])
    assert (got[long + 3].starts, got[long + 3].ends) == ([3], [44])
