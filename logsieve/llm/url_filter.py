"""URL filters (DataFrame functions only).

Rules (host, path, verdict) decide first: a rule fits its host and all subdomains when the
url's path starts with the rule's path, and the longest fitting rule wins.  Urls that no rule
fits are judged by a list of canonical urls: a blocked Bloom filter of the list lets possible
hits through, and a hash join on the whole canonical url removes the false positives.

The filter is a table of blocks (number, four 64-bit words), one block for every URLS_PER_BLOCK listed urls, so
false positives stay rare however long the list is.  Up to 2**BROADCAST_BITS blocks (8 MB) it is broadcast, and
urls that it rejects never move; a larger one is joined by block, where only the page's key and bits travel.
The list side of the exact join is a written table, so that both sides of it are plain
exchanges, which adaptive execution splits when one url holds many rows.

The production list is made from what the pages hold, not from their urls: the canonical urls of pages whose
html has words with all of LISTED_MARKS (symbol junk).  Other pages under the same canonical url are then judged by it.

Canonical form: host without a leading `www.`, then the path without trailing slashes; scheme,
query and fragment do not count.

Defined results: a null url or one without `://` has an empty host and path, no rule, and is
allowed (the empty canonical url is never listed); repeated rows are judged one by one; an
empty table gives no rows, an empty list lists nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the contract: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Marks of junk; a page that holds all of them puts its url on the production list (fixed values).
LISTED_MARKS = ["###", "$$$", "%%%"]

#: 256 bits for so many urls, about; and the largest filter that is broadcast: 262,144 blocks.
URLS_PER_BLOCK, BROADCAST_BITS, MOST_BITS = 12, 18, 30
WORDS = ["w0", "w1", "w2", "w3"]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    name, start, _ = rule
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], value) -> Column:
    """`value` of the longest fitting rule, null if none fits.  `rules` is configuration: a
    short list that becomes one expression."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*[F.when(rule_fits(host, path, r), F.lit(value(r))) for r in longest], F.lit(None).cast("string"))


def bits_for(urls: int) -> int:
    """Bits of the block numbers for a list of so many urls."""
    return min(MOST_BITS, max(1, (-(-urls // URLS_PER_BLOCK) - 1).bit_length()))


def block_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(0)), 64 - bits).cast("int")


def word_bits(key: Column) -> dict[str, Column]:
    """Two bits in each of the four words of the key's block, from one second hash."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.expr("shiftleft(1L, cast(__h >> {} & 63 as int))".format(6 * i))
    return {"__h": h} | {w: bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i, w in enumerate(WORDS)}


def with_bits(df: DataFrame, key: Column, bits: int) -> DataFrame:
    cols = word_bits(key)
    df = df.withColumn("__h", cols.pop("__h")).withColumn("__block", block_of(key, bits))
    return df.withColumns({f"__{w}": c for w, c in cols.items()}).drop("__h")


def bloom_filter(listed: DataFrame, bits: int) -> DataFrame:
    """One row per used block; `listed` has the column `listed_url`."""
    rows = with_bits(listed, F.col("listed_url"), bits)
    return rows.groupBy("__block").agg(*[F.bit_or(f"__{w}").alias(f"__f{w}") for w in WORDS])


def possible_hits(urls: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """`urls` has `__url`; adds `__maybe`: the filter does not rule the url out."""
    table = F.broadcast(blocks) if bits <= BROADCAST_BITS else blocks
    probe = with_bits(urls, F.col("__url"), bits).join(table, "__block", "left")
    inside = reduce(lambda a, b: a & b, [F.col(f"__f{w}").bitwiseAND(F.col(f"__{w}")) == F.col(f"__{w}") for w in WORDS])
    return (probe.withColumn("__maybe", F.coalesce(inside, F.lit(False)))
            .drop("__block", *[f"__{w}" for w in WORDS], *[f"__f{w}" for w in WORDS]))


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES,
               listed_verdict: str = "block", other_verdict: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, listed (null where a rule decided).
    `listed` has one column of canonical urls; it may repeat them."""
    host, path = F.col("host"), F.col("path")
    urls = (pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias("__raw"))
            .select(id_col, host_of(F.col("__raw")).alias("host"), path_of(F.col("__raw")).alias("path"))
            .withColumn("rule", first_rule(host, path, rules, lambda r: r[0] + r[1]))
            .withColumn("__verdict", first_rule(host, path, rules, lambda r: r[2]))
            .withColumn("__url", canonical(host, path)))
    names = listed.select(F.col(f"`{listed.columns[0]}`").alias("listed_url"))
    names = cut(names.filter("listed_url IS NOT NULL AND listed_url <> ''").distinct())

    bits = bits_for(names.count())
    judged = possible_hits(urls, bloom_filter(names, bits), bits)
    open_hit = F.col("__maybe") & F.col("rule").isNull()
    hits = (judged.filter(open_hit).join(names, F.col("__url") == F.col("listed_url"), "left")
            .withColumn("listed", F.col("listed_url").isNotNull()).drop("listed_url"))
    rest = judged.filter(~open_hit).withColumn("listed", F.when(F.col("rule").isNull(), F.lit(False)))
    verdict = F.coalesce("__verdict", F.when(F.col("listed"), F.lit(listed_verdict)).otherwise(F.lit(other_verdict)))
    return hits.unionByName(rest).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "listed")


def listed_urls(pages: DataFrame, marks: list[str] = LISTED_MARKS) -> DataFrame:
    """The production list: canonical urls of pages whose html holds all of `marks`."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    junk = reduce(lambda a, b: a & b, [F.contains(F.col("html"), F.lit(m)) for m in marks])
    return pages.filter(junk).select(canonical(host, path).alias("listed_url"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages.select("page_id", "url"), listed_urls(pages.select("url", "html")))


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)', 1, 's') AS path
  , contains(html, '###') AND contains(html, '$$$') AND contains(html, '%%%') AS bad
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id),
c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE bad AND canon <> ''),
j AS (SELECT c.page_id, c.host, c.path, fit.rule, fit.rverdict, l.canon IS NOT NULL AS hit
      FROM c LEFT JOIN fit USING (page_id) LEFT JOIN l USING (canon))
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS listed
FROM j
"""
