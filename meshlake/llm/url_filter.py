"""URL rules by a blocked Bloom filter and an exact hash join (operator 8).

A URL has one key for each suffix of its host and each length that a rule's path has.
Keys are probed against a Bloom filter whose blocks are eight 64-bit words of one row;
only those that may be listed reach the exact join, which removes false positives.
Distinct (host, path) are judged once each, so a host that many pages share is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import LOWER, UPPER, let, small_join
from meshlake.runtime import materialize

WORDS = 8
#: Greatest filter: 2^16 blocks of 64 bytes are 4 MB. More keys raise its false hits, which the exact join removes.
MAX_BLOCKS = 1 << 16
#: Rule tables of at most this many rows are broadcast, larger ones shuffled.
BROADCAST_RULES = 100_000


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no "://"."""
    known = F.coalesce(url, F.lit(""))
    at = F.locate("://", known)
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _bits(h: Column, word: int) -> Column:
    """The bits that a key sets in one word of its block: three of the 512 in all."""
    wanted = F.lit(0).cast("long")
    for shift in (16, 25, 34):
        bit = F.pmod(F.shiftrightunsigned(h, shift), F.lit(512))
        own = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
        wanted = wanted.bitwiseOR(F.when(F.floor(bit / 64) == word, own).otherwise(F.lit(0).cast("long")))
    return wanted


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 43), F.lit(blocks))


def blocks_for(keys: int, most: int = MAX_BLOCKS) -> int:
    blocks = 1
    while blocks < min(keys / 24, most):
        blocks *= 2
    return blocks


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) over the column h of keys."""
    h = F.col("h")
    words = keys.select(_block(h, blocks).alias("block"), *[_bits(h, i).alias(f"w{i}") for i in range(WORDS)])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def may_be_listed(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    h = F.col("h")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (_bits(h, i).bitwiseAND(F.bitwise_not(F.col(f"w{i}"))) == 0)
    # at most MAX_BLOCKS rows of nine longs
    return probes.withColumn("block", _block(h, blocks)).join(F.broadcast(bloom), "block").where(hit).drop("block", *[f"w{i}" for i in range(WORDS)])


def host_suffixes(host: Column) -> Column:
    """The host and every domain that it is a subdomain of."""
    return let(F.split(host, r"\."), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict, one row for each row of pages.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the
    page's path starts with the rule's; of those that fit the longest wins, and of
    equally long ones the longer host. Rules listed twice count once, block before
    allow. A page that no rule fits has a null rule and the default verdict. Null, empty
    and repeated URLs, extra columns, empty tables of pages or rules are all taken.
    """
    own = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null")
    own = own.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    own = materialize(own.withColumn("h", F.xxhash64("r_host", "r_path")), "rules")
    blocks = blocks_for(own.count())
    host, path = canonical(F.col(url))
    keyed = pages.withColumn("host", host).withColumn("path", path)
    distinct = materialize(keyed.select("host", "path").distinct(), "urls")
    # one number for each length of a rule's path, and a path has at most some thousand characters
    lengths = F.broadcast(own.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths")).withColumn("one", F.lit(1)))
    probes = distinct.withColumn("one", F.lit(1)).join(lengths, "one").select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("r_host"), "lengths")
    probes = probes.select("host", "path", "r_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    probes = probes.select("host", "path", "r_host", F.expr("left(path, n)").alias("r_path")).withColumn("h", F.xxhash64("r_host", "r_path"))
    possible = may_be_listed(probes, bloom_filter(own.select("h"), blocks), blocks).drop("h")
    hits = small_join(possible, own.drop("h"), ["r_host", "r_path"], limit=BROADCAST_RULES)
    longest = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), longest).alias("__best"))
    judged = keyed.join(best, ["host", "path"], "left")
    return judged.select(*[F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
