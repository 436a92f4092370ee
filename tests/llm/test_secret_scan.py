import hashlib
import random
import re

from pyspark.sql import Row

from meshlake.llm import secret_scan as ss

LETTERS = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")}
ASSIGN = re.compile("(" + "|".join(LETTERS.values()) + r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]" + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_scan_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["password", "PassWd", " = ", ":", "'", '"', "abcDEF12345", "AKIA", "ABCDEFGHIJKL1234", "0123456789abcdef" * 2, "ab", "api_key", "APIKEY", "token", "Key", "é", "\n", " ", "secret=short", "=", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "x" * 200_000 + "AKIAABCDEFGHIJKLMN" + "y" * 10]
    rows = [Row(doc_id=i, text=t, kind="x", spans="y") for i, t in enumerate(texts)] + [Row(doc_id=None, text="secret: 12345678", kind="", spans=""), Row(doc_id=0, text=texts[0], kind="", spans="")]
    got = ss.scan(spark.createDataFrame(rows, "doc_id long, text string, kind string, spans string")).collect()
    assert len(got) == len(rows)
    for row in got:
        text = "secret: 12345678" if row.doc_id is None else texts[row.doc_id]
        assert [(x.kind, x.start, x.end) for x in row.spans if x.kind in ("assign", "access", "hex")] == brute(text)


def test_queries_are_necessary():
    for rule in ss.BASE_RULES + ss.MORE_RULES:
        assert ss.trigram_query(rule.pattern)
    assert ss.trigram_query(r"AKIA[A-Z0-9]+") == frozenset([frozenset([b"aki", b"kia"])])
    assert ss.trigram_query(r"[0-9a-f]+") == frozenset([frozenset()])
    assert ss.trigram_query(r"(abc|xyz)?q") == frozenset([frozenset()])
    assert ss.trigram_query(r"(abc|xyz)+.*uvw") == frozenset([frozenset([b"abc", b"uvw"]), frozenset([b"xyz", b"uvw"])])


def test_added_rules_and_empty_table(spark):
    text = "-----BEGIN RSA PRIVATE KEY-----\nghp_" + "a1B2" * 10
    row = ss.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [x.kind for x in row.spans] == ["private_key", "github"]
    assert ss.scan(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_query_digests(spark, tmp_path):
    from meshlake.llm.queries import op7_secrets

    text = "token = abcdefgh12 " + "f" * 40
    spark.createDataFrame([(4, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    row = op7_secrets(spark, str(tmp_path)).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 0, 1)
    assert row.spans == "assign:0:18,hex:19:59" and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
