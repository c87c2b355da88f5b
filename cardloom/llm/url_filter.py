"""URL filters by temporal list join: dated entries become intervals, captures meet those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.line_dedup import wide_hash
from cardloom.session import table, written

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a final dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def lookup_keys(host: Column, path: Column) -> Column:
    """Patterns that could match: the host and its parent domains, and the host with each prefix of whole path segments.

    Each with its rank: a longer domain before a shorter one, any path before a domain, a longer path first.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("rank"), F.array_join(F.slice(labels, n - i + 1, i), ".").alias("pattern")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    m = F.size(parts)
    made = F.transform(F.sequence(F.lit(1), m), lambda i: F.struct((i + 1000).alias("rank"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern")))
    return F.when(m > 0, F.concat(domains, made)).otherwise(domains)


def clean_entries(entries: DataFrame) -> DataFrame:
    """pattern, at, action: one entry for each pattern and time, the last action by name; hosts in lower case, paths as they are."""
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1))
    known = entries.filter(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isNotNull())
    return known.groupBy(pattern.alias("pattern"), F.col("listed_at").alias("at")).agg(F.max("action").alias("action"))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to: each dated entry holds until the next one of its pattern; removals hold nothing."""
    after = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return clean_entries(entries).withColumn("valid_to", after).filter("action <> 'remove'").select("pattern", "action", F.col("at").alias("valid_from"), "valid_to")


def as_of(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (pattern, at and others) with action, the last of its pattern at or before at; null if there is none.

    Captures and entries are sorted together by pattern and time, and the last entry is carried
    forward: a capture costs one row however many entries its pattern has. A pattern that many
    captures share fills many ranges of the sort; a range's last entry of each pattern is carried
    over to the ranges after it, which takes one row for each range and pattern.
    """
    columns = [c for c in asked.columns if c not in ("pattern", "at")]
    listed = entries.select("pattern", "at", "action", F.lit(0).alias("_kind"), *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in columns))
    both = listed.unionByName(asked.select("pattern", "at", F.lit(None).cast("string").alias("action"), F.lit(1).alias("_kind"), *columns))
    order = ["pattern", "at", "_kind"]
    spread = F.xxhash64(*columns) if columns else F.lit(0)
    ranged = written(both.withColumn("_spread", spread).repartitionByRange(*order, "_spread").withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", "pattern").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy("pattern", "_range").agg(F.max(F.when(F.col("_kind") == 0, F.struct("at", "action"))).alias("_last"))
    earlier = Window.partitionBy("pattern").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(ends.select("pattern", "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried is not null"))
    filled = ranged.withColumn("_own", F.last("action", ignorenulls=True).over(within)).filter("_kind = 1")
    return filled.join(carried, ["pattern", "_range"], "left").select("pattern", "at", *columns, F.coalesce("_own", "_carried.action").alias("action"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures with host, pattern, action and blocked.

    An entry's pattern is a domain (it covers its subdomains) or a host with whole path segments.
    Of the entries active when a capture was fetched (from their date until the next entry of the
    pattern; removals hold nothing) the most specific decides: a longer path, then a longer domain.
    Without one, or with a null or hostless url or a null time, action is null and blocked false.
    Repeated captures are decided alike, other columns stay but for those named like the added
    ones, empty tables give empty results or no decisions. Urls of any length count as a whole.
    Paths compare as they are, hosts in lower case.

    A capture's patterns meet the list by an as-of join on pattern and time. Only patterns that the
    list holds take part: they are found by equality, which adaptive execution splits for a
    domain that many captures share.
    """
    body = captures.drop("host", "pattern", "action", "blocked").withColumn("host", host_of(F.col(url)))
    first, second = wide_hash(F.col(url), F.col(fetched))
    body = body.withColumn("_row", F.struct(first.alias("a"), second.alias("b")))
    listed = written(clean_entries(entries))
    asked = body.filter(F.col("host").isNotNull() & F.col(fetched).isNotNull()).select("_row", F.col(fetched).alias("at"), F.explode(lookup_keys(F.col("host"), path_of(F.col(url)))).alias("_key"))
    keys = asked.select("_row", "at", "_key.rank", "_key.pattern").join(written(listed.select("pattern").distinct()), "pattern", "left_semi")
    hits = as_of(keys.distinct(), listed).filter("action <> 'remove'")
    best = hits.groupBy("_row").agg(F.max(F.struct("rank", "pattern", "action")).alias("_best"))
    joined = body.join(written(best), "_row", "left")
    return joined.withColumn("pattern", F.col("_best.pattern")).withColumn("action", F.col("_best.action")).withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False))).drop("_row", "_best")


def sample_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched_at: the pages with a fetch minute of 2024 made from the id, as they carry none."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(525600)) * 60)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """pattern, action, listed_at: a dated list over the hosts of the pages and their domains, made from hashes of the names."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).filter("h is not null").distinct()
    parents = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("p")).filter("p <> ''").distinct()
    digit = lambda name, at, n: F.conv(F.substring(F.md5(name), at, n), 16, 10).cast("long")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    verdict = lambda name: F.when(digit(name, 5, 1) < 8, "block").otherwise("allow")
    h, p = F.col("h"), F.col("p")
    return (
        hosts.select(h.alias("pattern"), verdict(h).alias("action"), day(digit(h, 1, 2) % 150).alias("listed_at"))
        .union(hosts.select(h, F.lit("remove"), day(digit(h, 1, 2) % 150 + 30 + digit(h, 3, 2) % 90)))
        .union(hosts.select(F.concat(h, F.lit("/en")), F.when(digit(h, 6, 1) < 8, "allow").otherwise("block"), day(digit(h, 7, 2) % 200)))
        .union(parents.select(p, verdict(p), day(digit(p, 1, 2) % 300)))
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page decided by the list entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(sample_captures(pages), sample_entries(pages)).select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), "pattern", "action", "blocked")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {
    "op6_url_filter": r"""
WITH c AS (
  SELECT row_number() OVER () AS rid, page_id, 1704067200 + ((page_id * 7919) % 525600) * 60 AS t,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '.'), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
p AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS d FROM h WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''),
e AS (
  SELECT host AS pattern, CASE WHEN ('0x' || substr(md5(host), 5, 1))::BIGINT < 8 THEN 'block' ELSE 'allow' END AS action,
    1704067200 + (('0x' || substr(md5(host), 1, 2))::BIGINT % 150) * 86400 AS at_s FROM h
  UNION ALL SELECT host, 'remove', 1704067200 + (('0x' || substr(md5(host), 1, 2))::BIGINT % 150 + 30 + ('0x' || substr(md5(host), 3, 2))::BIGINT % 90) * 86400 FROM h
  UNION ALL SELECT host || '/en', CASE WHEN ('0x' || substr(md5(host), 6, 1))::BIGINT < 8 THEN 'allow' ELSE 'block' END,
    1704067200 + (('0x' || substr(md5(host), 7, 2))::BIGINT % 200) * 86400 FROM h
  UNION ALL SELECT d, CASE WHEN ('0x' || substr(md5(d), 5, 1))::BIGINT < 8 THEN 'block' ELSE 'allow' END,
    1704067200 + (('0x' || substr(md5(d), 1, 2))::BIGINT % 300) * 86400 FROM p
), spans AS (
  SELECT pattern, action, at_s, lead(at_s) OVER (PARTITION BY pattern ORDER BY at_s) AS until FROM (
    SELECT pattern, at_s, max(action) AS action FROM e GROUP BY ALL)
), hits AS (
  SELECT c.rid, s.pattern, s.action, row_number() OVER (PARTITION BY c.rid ORDER BY contains(s.pattern, '/') DESC, length(s.pattern) DESC) AS r
  FROM c JOIN spans s ON s.action <> 'remove' AND c.t >= s.at_s AND (s.until IS NULL OR c.t < s.until)
   AND (c.host = s.pattern OR c.host LIKE '%.' || s.pattern OR starts_with(c.host || c.path || '/', s.pattern || '/'))
)
SELECT c.page_id, c.host, c.t::BIGINT AS fetched_s, hits.pattern, hits.action, coalesce(hits.action = 'block', false) AS blocked
FROM c LEFT JOIN hits ON hits.rid = c.rid AND hits.r = 1
"""
}
