"""URL verdicts: a blocked Bloom filter lets possible hits pass to an exact hash join.

The list holds canonical URLs (host, then path), each with a verdict, in two kinds: rules fit their host with all its
subdomains and every path that begins with theirs; whole addresses fit one host and path only. Every distinct address of the
pages is looked up under the few keys that could be listed (the ends of its host and beginnings of its path that have a
length some rule has, and the whole); a key that the filter may hold goes on to an exact join with the list. A key's 256-bit
block in the filter is found by one hash, its bits by another; the blocks are a table that is built by aggregation, and
broadcast only where its number of rows, which is set beforehand, is at most BROADCAST_BLOCKS.

Defined results: a url that is null or has no `://` has an empty host and path; an empty host fits no rule. Of rules for one
key the verdict block wins. The longest rule wins, and any rule goes before a whole address. Repeated rows each get their
verdict, a null page_id is kept, and extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut

BLOCK_WORDS = 4  # of 64 bits
BITS_PER_KEY = 16
BROADCAST_BLOCKS = 1 << 16
ALLOW, BLOCK = "allow", "block"


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def masks(key: Column) -> list[Column]:
    """Two bits for each word of the key's block."""
    bits = F.xxhash64(F.lit("bits"), key)

    def one(k: int) -> Column:
        place = F.shiftrightunsigned(bits, 5 * k).bitwiseAND(F.lit(31)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place + F.lit(32 * (k % 2)))

    return [one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(BLOCK_WORDS)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0, w1, ...): the filter's blocks that have bits, from a frame with a column key."""
    rows = keys.select(block_of(F.col("key"), n_blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks(F.col("key")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)))


def passed(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose key the filter may hold."""
    small = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks
    probed = rows.withColumn("block", block_of(F.col("key"), n_blocks)).join(small, "block")
    for i, m in enumerate(masks(F.col("key"))):
        probed = probed.where(F.col(f"w{i}").bitwiseAND(m) == m)
    return probed.select(*rows.columns)


def n_blocks_for(n_keys: int) -> int:
    n = 1
    while n * 64 * BLOCK_WORDS < n_keys * BITS_PER_KEY:
        n *= 2
    return n


def judge(pages: DataFrame, rules: DataFrame, *, listed: DataFrame | None = None, url: str = "url", key: str = "page_id", default: str = ALLOW) -> DataFrame:
    """key, host, path, rule (the longest that fits, or null) and verdict.

    rules: (host, path, verdict); listed: (url, verdict) of whole addresses. An address that neither has gets `default`.
    """
    host, path = address(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rules = rules.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), F.lit(1).alias("prefix"), "verdict")
    whole = pages.sparkSession.createDataFrame([], "key string, verdict string") if listed is None else listed.select(F.concat(*address(F.col("url"))).alias("key"), "verdict")
    table = rules.select("key", "prefix", "verdict").union(whole.where("key != ''").select("key", F.lit(0), "verdict"))
    table = table.groupBy("key", "prefix").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    kinds = rules.select("labels", "chars").distinct().collect()  # lengths that rules have, not rules
    n_blocks = n_blocks_for(table.count())
    blocks = bloom_blocks(table.select("key").distinct(), n_blocks)
    addresses = rows.select("host", "path").where("host != ''").distinct()
    n_labels = F.size(F.split("host", r"\."))
    looked = [F.when((n_labels >= k.labels) & (F.length("path") >= k.chars), F.concat(F.substring_index("host", ".", -k.labels), F.substring("path", 1, k.chars))) for k in kinds]
    asked = [F.struct(c.alias("key"), F.lit(1).alias("prefix")) for c in looked] + [F.struct(F.concat("host", "path").alias("key"), F.lit(0).alias("prefix"))]
    asked = addresses.select("host", "path", F.explode(F.array(*asked)).alias("a")).select("host", "path", "a.key", "a.prefix").where("key IS NOT NULL")
    hits = passed(asked, blocks, n_blocks).join(table, ["key", "prefix"])
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("key", "prefix", "verdict"), F.struct("prefix", F.length("key"), "key")).alias("b"))
    # written, then joined over plain shuffles, which Spark can split: the pages of one address are no one task's
    best = cut(best.select("host", "path", F.when(F.col("b.prefix") == 1, F.col("b.key")).alias("rule"), F.col("b.verdict").alias("verdict")))
    return rows.join(best.hint("merge"), ["host", "path"], "left").select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
