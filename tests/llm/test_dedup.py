import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from meshlake.llm import exact_dedup, line_dedup, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(LOWER)


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.hex(F.length(t) % 7))])
def test_exact_dedup(docs, rows, keep, digest):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for r in rows:
        known = [i for i in groups[norm(r[1])] if i is not None]
        best = (max(known) if keep == "max" else min(known)) if known else None
        want.append((r[0], best, len(groups[norm(r[1])]), r[0] == best, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs, keep=keep, digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_dedup(none).collect() == []


def shingled(text, words):
    found = norm(text).encode().split()
    if not found:
        return 0
    parts = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return fp - (1 << 64) if fp >> 63 else fp


def components(fps, distance):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = list(parent)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {f: find(f) for f in listed}


def test_near_dedup(docs, rows):
    fps = [shingled(r[1], 4) for r in rows]
    root = components(fps, 4)
    members = {}
    for r, f in zip(rows, fps, strict=True):
        members.setdefault(root[f], []).append(r[0])
    want = [(r[0], f, min((i for i in members[root[f]] if i is not None), default=None), len(members[root[f]])) for r, f in zip(rows, fps, strict=True)]
    got = simhash.near_dedup(docs, 4, 4).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("distance", [1, 4, 7])
def test_components_of_dense_fingerprints(spark, distance):
    import random

    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, -1}
    for b in base:
        for _ in range(25):
            for bit in rng.sample(range(64), rng.randint(0, distance)):
                b ^= 1 << bit
            fps.add(b - (1 << 64) if b >> 63 else b)
    got = {r.fp: r.component for r in simhash.near_components(spark.createDataFrame([(f,) for f in fps], "fp long"), distance).collect()}
    want = components(fps, distance)
    groups = lambda m: sorted(sorted(f for f in m if m[f] == c) for c in set(m.values()))
    assert groups(got) == groups(want)


def test_keep_one(docs, rows, none):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1000 not in ids and 1001 not in ids and None in ids
    assert simhash.keep_one(none).collect() == [] and simhash.near_dedup(none).collect() == []


def brute_lines(rows, min_sites):
    strip = "\t\n\x0b\x0c\r "
    sites, first = {}, {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if x.strip(strip):
                sites.setdefault(x.strip(strip), set()).add(r[3])
                if r[0] is not None:
                    first[x.strip(strip)] = min(first.get(x.strip(strip), r[0]), r[0])
    out = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        gone = [bool(x.strip(strip)) and len(sites[x.strip(strip)]) >= min_sites and first.get(x.strip(strip)) != r[0] for x in parts]
        out.append((r[0], None if r[1] is None else "\n".join(x for x, g in zip(parts, gone, strict=True) if not g), sum(bool(x.strip(strip)) for x in parts), sum(gone)))
    return out


@pytest.mark.parametrize("min_sites", [2, 4])
def test_line_dedup(docs, rows, none, min_sites):
    got = line_dedup.line_dedup(docs, min_sites=min_sites)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    found = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_lines(rows, min_sites)))
    assert line_dedup.line_dedup(none, min_sites=min_sites).collect() == []


def test_spread_near_the_threshold_is_exact(spark):
    rows = [(d, f"line {k}", f"s{d % (36 + k)}") for k in range(9) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_dedup.boilerplate(line_dedup.numbered_lines(docs), 40, lg_k=6).count()
    assert found == 5


def test_keep_one_drops_near_copies_and_keeps_others(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(4000)]
    rows, group = [], {}
    for g in range(40):
        base = rng.choices(words, k=220)
        for k in range(4):
            text = list(base)
            for at in rng.sample(range(220), min(k, 3)):
                text[at] = rng.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert {group[i] for i in kept} == set(range(40)) and len(kept) <= 46
