import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.llm import quality, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", None, "x\nx\n\n \nx", "é日 𝒳 #*<b>|&$%", "a\x0bb\x0cc\xa0d", "p q r s p q r t q r s", "w " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = quality.base_counts(docs, ["doc_id"]).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in got} == {i: base(t) for i, t in enumerate(texts)}


def by_hand(points, share, floor):
    """The estimate of one group from an array of statistics: three starts, two steps, the best to its end."""
    x = points / 256.0
    h = share * len(x)

    def estimate(w):
        mu = (w[:, None] * x).sum(0) / w.sum()
        return mu, ((w[:, None] * x).T @ x / w.sum() - np.outer(mu, mu)) * quality.consistency(share, x.shape[1])

    def step(mu, cov, add):
        inverse = np.linalg.inv(cov + np.diag(add))
        d2 = np.einsum("ij,jk,ik->i", x - mu, inverse, x - mu)
        bins = np.floor(np.log2(d2 + 1e-6) * 32)
        w, before = np.zeros(len(x)), 0
        for value in np.unique(bins):
            here = bins == value
            w[here] = min(max((h - before) / here.sum(), 0.0), 1.0)
            before += here.sum()
        return (*estimate(w), floor)

    logdet = lambda p: np.linalg.slogdet(p[1] + np.diag(floor))[1]
    ordered = np.sort(x, axis=0)
    at = lambda p: ordered[-(-p * len(x) // 10) - 1]
    zero = np.zeros(x.shape[1])
    plain = x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))
    first = [(at(5), np.eye(x.shape[1]), zero), (x.mean(0), plain, floor), (at(5), np.diag(((at(9) - at(1)) / (2 * 1.2815515655446004)) ** 2), floor)]
    best = min((step(*step(*p)) for p in first), key=logdet)
    while True:
        after = step(*best)
        if logdet(best) - logdet(after) <= 1e-6:
            return after[:2]
        best = after


def verdicts(rows, min_words=50):
    """(kept, d2) of each row by dense linear algebra."""
    def stats(r):
        n, chars, symbols, dup, repeat = base(r[1])
        m = max(n, 1)
        return [math.floor(v * 256 + 0.5) for v in (math.log(max(chars, 1) / m), *(math.log(1 + 100 * c / m) for c in (symbols, dup, repeat)))]

    failed = [base(r[1])[0] < min_words or 100 * base(r[1])[4] > 50 * base(r[1])[0] for r in rows]
    points = np.array([stats(r) for r in rows], float)
    floor = np.array(quality.floors())
    passed = [i for i in range(len(rows)) if not failed[i]]
    found = {}

    def drawn(key, parent):
        mine = [i for i in passed if all(k is None or k == (rows[i][2], rows[i][3])[j] for j, k in enumerate(key))]
        mu, cov = by_hand(points[mine], 0.75, floor)
        part = 1.0 if parent is None else len(mine) / (len(mine) + 40.0)
        found[key] = (mu, cov) if parent is None else (part * mu + (1 - part) * parent[0], part * cov + (1 - part) * parent[1])
        return found[key]

    out = []
    # None stands for any here, so null names are spelt out
    rows = [(r[0], r[1], r[2] or "", r[3] or "") for r in rows]
    whole = drawn((None, None), None) if passed else None
    for i, r in enumerate(rows):
        if failed[i]:
            out.append((False, None))
            continue
        lang = found.get((r[2], None)) or drawn((r[2], None), whole)
        mu, cov = found.get((r[2], r[3])) or drawn((r[2], r[3]), lang)
        z = points[i] / 256.0 - mu
        d2 = z @ np.linalg.inv(cov + np.diag(floor)) @ z
        out.append((bool(d2 <= quality.chi_square_quantile(0.975, 4)), d2))
    return out


def test_judge(docs, rows, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    want = {r[0]: v for r, v in zip(rows, verdicts(rows), strict=True)}
    for r in got:
        assert tuple(r[c] for c in COUNTS) == base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        kept, d2 = want[r.doc_id]
        assert r.kept == kept and (r.d2 == d2 or abs(r.d2 - d2) < 1e-6 * (1 + d2)), (r, want[r.doc_id])
    junk = {i for i, t in texts.items() if t and t.count("&&&") > 20}
    kept = {r.doc_id for r in got if r.kept}
    assert junk and not junk & kept
    assert kept >= {r.doc_id for r in got if not r.base_failed} - junk
    assert quality.judge(none).collect() == []


def test_judge_against_scattered_groups(spark):
    """Groups from one document to many, with outliers that a single start can miss."""
    rng = random.Random(4)
    rows = []
    for g, n in enumerate((1, 2, 7, 60, 200)):
        for _ in range(n):
            odd = rng.random() < 0.2
            k = rng.randint(60, 120)
            words = ["".join(rng.choices("abcdefgh", k=rng.randint(9, 14) if odd else rng.randint(3, 7))) + ("#" if rng.random() < (0.3 if odd else 0.02) else "") for _ in range(k)]
            rows.append((len(rows), " ".join(words), "xy"[g % 2], f"s{g}"))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for r, (kept, d2) in zip(rows, verdicts(rows), strict=True):
        assert got[r[0]].kept == kept and abs(got[r[0]].d2 - d2) < 1e-6 * (1 + d2)
    assert 5 < sum(not r.kept for r in got.values()) < 100


def test_chi_square():
    # even degrees have a closed form
    for x in (0.5, 3.0, 11.0, 40.0):
        assert abs(quality.chi_square(x, 4) - (1 - math.exp(-x / 2) * (1 + x / 2))) < 1e-12
    assert abs(quality.chi_square_quantile(0.975, 4) - 11.143287) < 1e-5


def test_keep_good(docs, spark):
    kept = sorted(str(r.doc_id) for r in quality.judge(docs).collect() if r.kept)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == kept
    names = {"n_words": 1, "row": 2, "g_lang": 3, "__text": 4, "d2": 5, "kept": 6, "s_dup": 7, "bin": 8}
    clash = docs.withColumns({k: F.lit(v) for k, v in names.items()})
    again = quality.keep_good(clash)
    assert again.columns == clash.columns and sorted(str(r.doc_id) for r in again.collect()) == kept


def test_estimate_ignores_outliers(spark):
    rng = random.Random(1)
    rows = [("all", rng.randint(-10, 10) + (5000 if i % 5 == 0 else 0), rng.randint(0, 20), 0, 0, 1) for i in range(400)]
    row = quality.mcd(spark.createDataFrame(rows, "g string, s_wordlen long, s_symbols long, s_dup long, s_repeat long, w long")).first()
    assert abs(row.mu0) < 5 and 5 < row.mu1 < 15


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), ("a.net", "", "block")]


def verdict(url):
    m = re.match(r"^(?:(?!://).)*://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("most", [1, 1 << 16])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
    urls = ["https://www.Example.com/en/a?b", "http://example.com/en/", "http://x.example.com/en", "http://com/", "http://com", "https://net/es/x#y", "ftp://b.a.net", "http://anet/", "http://a.net/es/", None, "", "nothing", "http://", "a://b://c/", "http://xcom/", "http://" + "s." * 60 + "com/" + "p" * 5000, "http://com/"]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)], "page_id int, url string, rule string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: verdict(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).collect() == []


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) h")
    blocks = url_filter.blocks_for(20_000)
    bloom = url_filter.bloom_filter(keys, blocks)
    assert url_filter.may_be_listed(keys, bloom, blocks).count() == 20_000
    others = spark.range(100_000, 200_000).selectExpr("xxhash64(id) h")
    assert url_filter.may_be_listed(others, bloom, blocks).count() < 5_000
