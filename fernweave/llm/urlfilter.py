"""URL filters: host and path rules, and a blocked Bloom filter of listed canonical URLs with an exact join
behind it. DataFrame operations only.

The list's canonical URLs set ``BITS`` bits each in one 256-bit block of the filter; blocks are rows
(block, four words), made by one aggregation. A page's URL looks at one block. Only possible hits go on to
the exact hash join with the list, which removes the false positives. What is broadcast is counted first;
beyond the bound both joins are shuffled, with rows of one key dealt over several places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import looked_up

# Fixed values of the contract: host, path prefix, verdict.
RULES: list[tuple[str, str, str]] = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits set for a URL in its block, and URLs for a block of 256 bits: about 25 bits a URL, false hits under 1 in 1000.
BITS, PER_BLOCK = 6, 10


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null and no :// give the empty text."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without slashes at its end: scheme, query, fragment and a final slash make no difference."""
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def _bit(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(256))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the canonical URLs in column ``url_key``."""
    keyed = listed.select(F.pmod(F.xxhash64("url_key"), F.lit(blocks)).alias("block"), F.array(*[_bit(F.col("url_key"), i) for i in range(BITS)]).alias("bits"))
    word = lambda k: F.aggregate("bits", F.lit(0).cast("long"), lambda acc, b: F.when(F.shiftright(b, 6) == k, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int")))).otherwise(acc))
    return keyed.select("block", *[word(k).alias(f"w{k}") for k in range(4)]).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def _maybe(key: Column) -> Column:
    """Whether all bits of the key are set in the block's words beside it."""
    out = F.lit(True)
    for i in range(BITS):
        b = _bit(key, i)
        w = F.when(b < 64, F.col("w0")).when(b < 128, F.col("w1")).when(b < 192, F.col("w2")).otherwise(F.col("w3"))
        out = out & (F.call_function("getbit", w, F.pmod(b, F.lit(64)).cast("int")) == 1)
    return out


def listed_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct canonical URLs of a list; null URLs and such without a host name nothing."""
    u = F.col(url_col)
    return urls.select(canonical(host_of(u), path_of(u)).alias("url_key"), host_of(u).alias("_h")).filter("_h != ''").select("url_key").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: its id, ``host``, ``path``, ``rule`` (of the rules that fit, the longest; else null),
    ``verdict`` (the rule's; else block if the canonical URL is in ``listed``, allow if not), ``listed``.

    ``listed`` is a frame with a column ``url_key``, as listed_urls() makes it. A null URL, or one without ://,
    has an empty host and path, fits no rule and is allowed. Repeated rows and null ids stay; other columns
    aren't read; either table may be empty. Of rules of one length the first in order wins.
    """
    rules = RULES if rules is None else rules
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0] + rules[i][1]), i))
    host, path = F.col("host"), F.col("path")
    rule = verdict = None
    for i in order:
        fit, r = _fits(host, path, rules[i]), rules[i]
        rule = F.when(fit, F.lit(r[0] + r[1])) if rule is None else rule.when(fit, F.lit(r[0] + r[1]))
        verdict = F.when(fit, F.lit(r[2])) if verdict is None else verdict.when(fit, F.lit(r[2]))
    u = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    base = base.select("*", canonical(host, path).alias("url_key"))
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("url_key") + 8), F.lit(0))).first()
    if n:
        blocks = -(-n // PER_BLOCK)
        place = F.when(host != "", F.pmod(F.xxhash64("url_key"), F.lit(blocks)))
        looked = looked_up(base.withColumn("block", place), bloom_blocks(listed, blocks), ["block"], 40 * blocks, "left")
        looked = looked.withColumn("_maybe", F.coalesce(_maybe(F.col("url_key")), F.lit(False))).drop("block", "w0", "w1", "w2", "w3")
        exact = listed.select(F.col("url_key").alias("_key"), F.lit(True).alias("_in"))
        keyed = looked.withColumn("_key", F.when(F.col("_maybe"), F.col("url_key")))
        if size <= common.BROADCAST_BYTES:
            hits = looked_up(keyed, exact, ["_key"], size, "left")
        else:
            # Only possible hits are shuffled; the others stay where they are.
            hits = looked_up(keyed.filter("_maybe"), exact, ["_key"], size, "left").unionByName(keyed.filter(~F.col("_maybe")).withColumn("_in", F.lit(False)))
        base = hits.select("_id", "host", "path", F.coalesce("_in", F.lit(False)).alias("listed"))
    else:
        base = base.select("_id", "host", "path", F.lit(False).alias("listed"))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return base.select(F.col("_id").alias(id_col), "host", "path", (rule if rule is not None else F.lit(None).cast("string")).alias("rule"), (F.coalesce(verdict, own) if verdict is not None else own).alias("verdict"), "listed")


#: The registered query's list: canonical URLs of pages on hosts with one of these labels, at any place, and one
#: canonical URL in sixteen, by its digest, so that no table has an empty list.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DIGESTS = "0"


def feed_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Column ``url_key``: the list of the registered query, which the given tables don't hold."""
    u = F.col(url_col).cast("string")
    named = F.arrays_overlap(F.split("_h", "[.]"), F.array(*map(F.lit, LISTED_LABELS)))
    keys = pages.select(canonical(host_of(u), path_of(u)).alias("url_key"), host_of(u).alias("_h")).filter("_h != ''")
    return keys.filter(named | F.md5(F.col("url_key").cast("binary")).startswith(LISTED_DIGESTS)).select("url_key").distinct()


def oracle_sql() -> str:
    """The registered query in DuckDB's SQL, with rules and list written out: it shares no constant with the code above."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH cut AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    keyed AS (SELECT *, host || regexp_replace(path, '/+$', '') AS k FROM cut),
    feed AS (SELECT DISTINCT k FROM keyed WHERE host <> '' AND (md5(k) LIKE '0%' OR regexp_matches(host, '(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)([.]|$)'))),
    seen AS (SELECT page_id, host, path, host <> '' AND k IN (SELECT k FROM feed) AS listed,
      (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' AS net,
      (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' AS en,
      (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' AS de,
      (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' AS fr FROM keyed)
    SELECT page_id, host, path,
      CASE WHEN en THEN 'example.net/en/' WHEN de THEN 'example.com/de/' WHEN fr THEN 'org/fr/' WHEN net THEN 'net/' END AS rule,
      CASE WHEN en THEN 'allow' WHEN de THEN 'block' WHEN fr THEN 'allow' WHEN net THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
    FROM seen"""
