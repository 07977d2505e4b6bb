"""URL filters by a temporal list join.

A list's entries are dated: from its day on an entry blocks or allows a pattern, or drops it from the list. Each
entry is valid until the pattern's next one, so entries become validity intervals, and a capture is judged by
those intervals that hold its fetch day. A pattern is a domain, which covers its subdomains, or a host with the
beginning of a path, in whole segments. Of the patterns that hold, the longest decides.

A capture asks for few keys: its host, the host's parent domains, and the host with each beginning of its path up
to as many segments as the list's longest pattern has. So the as-of join is an equality join on keys with a range condition. A list of at most
BROADCAST_ROWS intervals, counted first, is broadcast; a longer one is copied by salt, since one host may
hold much of the captures.

Nulls: a null or unparsable url has no host and no key, and is kept; so is a capture without fetch day. Entries
with a null pattern or day don't count. Of entries with one pattern and day the last by action counts. Captures
that repeat are judged alike and come out each. An empty list blocks nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, SALTS, table

BLOCK, ALLOW, DROP = "block", "allow", "drop"
#: A small dated list for the query: names that sell, in three zones, each with its history.
NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ZONES = ("com", "net", "org")
HISTORY = (("2024-01-15", BLOCK), ("2024-05-01", DROP), ("2024-07-10", BLOCK), ("2024-11-20", ALLOW))
#: Patterns with paths: a section of one host, later allowed again.
SECTIONS = (("tionsh.example.net/en", "2024-03-01", BLOCK), ("tionsh.example.net/en", "2024-06-01", ALLOW), ("example.org/es", "2024-02-01", BLOCK))


def sample_entries() -> list[tuple[str, str, str]]:
    """Rows (pattern, day, action)."""
    rows = [(f"{name}.example.{zone}", day, action) for name in NAMES for zone in ZONES for day, action in HISTORY]
    return rows + list(SECTIONS)


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (pattern, action, valid_from, valid_until): when each entry of (pattern, day, action) holds."""
    found = entries.filter("pattern is not null and day is not null").select(F.lower("pattern").alias("pattern"), F.col("day").cast("date").alias("day"), "action")
    latest = found.groupBy("pattern", "day").agg(F.max("action").alias("action"))
    after = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    rows = latest.select("pattern", "action", F.col("day").alias("valid_from"), F.coalesce(after, F.lit("9999-12-31").cast("date")).alias("valid_until"))
    return rows.filter(F.col("action") != DROP)


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"\A(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", F.regexp_replace(found, r"\.\z", ""))


def keys(url: Column, parts: int) -> Column:
    """What of a url a pattern of at most so many path segments may equal."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"\A(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*/([^?#]*)", 1)
    segments = F.slice(F.filter(F.split(F.lower(path), "/"), lambda s: s != ""), 1, parts)
    deep = F.flatten(
        F.transform(
            domains,
            lambda d: F.transform(segments, lambda _, i: F.concat(d, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))),
        )
    )
    return F.coalesce(F.array_distinct(F.concat(domains, deep)), F.array().cast("array<string>"))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_on, ...) with host, pattern, action, listed_on and blocked, in place of columns so named."""
    made = ("host", "pattern", "action", "listed_on", "blocked")
    captures = captures.select(*[c for c in captures.columns if c not in made])
    lists = intervals(entries)
    n, parts = lists.agg(F.count("*"), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    asked = captures.select("url", "fetched_on").distinct().withColumn("_key", F.explode(keys(F.col("url"), parts or 0)))
    holds = (F.col("fetched_on") >= F.col("valid_from")) & (F.col("fetched_on") < F.col("valid_until"))
    if n <= BROADCAST_ROWS:
        met = asked.join(F.broadcast(lists), (F.col("_key") == F.col("pattern")) & holds)
    else:
        salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = asked.withColumn("_salt", F.pmod(F.xxhash64("url", "fetched_on"), F.lit(SALTS)).cast("int"))
        met = asked.join(salted, (F.col("_key") == F.col("pattern")) & (asked["_salt"] == salted["_salt"]) & holds)
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "valid_from")).alias("_best")
    found = met.groupBy("url", "fetched_on").agg(best)
    out = captures.join(found, ["url", "fetched_on"], "left")
    return out.select(
        *captures.columns,
        host(F.col("url")).alias("host"),
        F.col("_best.pattern").alias("pattern"),
        F.col("_best.action").alias("action"),
        F.col("_best.valid_from").alias("listed_on"),
        F.coalesce(F.col("_best.action") == BLOCK, F.lit(False)).alias("blocked"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the sample list. The table has no fetch day: page_id gives one of the days of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    entries = spark.createDataFrame(sample_entries(), "pattern string, day string, action string")
    return judged(captures, entries)


def _sql() -> str:
    values = ", ".join(f"('{p}', DATE '{d}', '{a}')" for p, d, a in sample_entries())
    return rf"""
WITH entries(pattern, day, action) AS (VALUES {values}),
spans AS (
  SELECT pattern, action, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY pattern ORDER BY day), DATE '9999-12-31') AS valid_until FROM entries
), pages_on AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
    nullif(lower(regexp_extract(url, '^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    lower(regexp_extract(url, '^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*/([^?#]*)', 1)) AS path
  FROM pages
), hits AS (
  SELECT p.page_id, s.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.pattern) DESC, s.pattern DESC) AS best
  FROM pages_on p JOIN spans s ON s.action <> 'drop' AND p.fetched_on >= s.valid_from AND p.fetched_on < s.valid_until
    AND ('.' || p.host) LIKE ('%.' || split_part(s.pattern, '/', 1))
    AND (s.pattern NOT LIKE '%/%' OR ('/' || trim(p.path, '/') || '/') LIKE (substr(s.pattern, strpos(s.pattern, '/')) || '/%'))
)
SELECT p.page_id, p.url, p.fetched_on, p.host, h.pattern, h.action, h.valid_from AS listed_on, coalesce(h.action = 'block', false) AS blocked
FROM pages_on p LEFT JOIN hits h ON h.page_id = p.page_id AND h.best = 1
"""


OP2_SQL = _sql()
