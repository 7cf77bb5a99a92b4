"""URL filter lists that change over time, joined as of each capture's fetch.

A list is a log of dated entries: at some time a pattern (a path prefix, a host, or a domain with all
its subdomains) is blocked or allowed.  Each entry is valid until the next one on its pattern.  A capture is
looked up under every pattern that fits its URL, with the entry that is valid when it was
fetched; the most specific pattern decides, and what no entry covers is allowed.

The as-of join is a sort, not a comparison of all captures with all entries of a pattern: captures and interval starts
of one pattern and one slice of time are ordered together, and each capture takes the last start before it.
No pattern stands in one task as a whole: a slice with more than ``slice_rows`` captures and entries is cut into shorter
pieces, an interval that reaches into a piece comes from a prefix over one row per piece, a piece with more than ``slice_rows``
captures is salted, and equal captures are judged once.  Everything is DataFrame functions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerscope.llm.common import read

#: from the least to the most specific pattern
KINDS = ("domain", "host", "prefix")
SLICE_SECONDS, SLICE_ROWS = 86_400, 20_000


def url_host(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def url_first_segment(url):
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)


def url_patterns(url):
    """The patterns that fit a URL, as ``(level, pattern)``: every domain of two labels or more, the host, host and first path segment."""
    host, segment = url_host(url), url_first_segment(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(
        F.lit(0).alias("level"), (F.size(labels) - i + 1).alias("depth"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    one = lambda level, pattern: F.array(F.struct(F.lit(level).alias("level"), F.lit(0).alias("depth"), pattern.alias("pattern")))
    none = F.filter(domains, lambda d: F.lit(False))
    return F.when(F.coalesce(host, F.lit("")) == "", none).otherwise(F.concat(
        domains, one(1, host), F.when(segment == "", none).otherwise(one(2, F.concat(host, F.lit("/"), segment)))))


def logged(entries: DataFrame) -> DataFrame:
    """``level, pattern, valid_from, blocked``: the entries that count.

    Of several entries on a pattern at one time the one with the largest ``entry_id`` counts.
    """
    level = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    return (entries.where(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS))
            .groupBy(level.alias("level"), F.lower("pattern").alias("pattern"), F.col("at").alias("valid_from"))
            .agg(F.max(F.struct("entry_id", F.coalesce("blocked", F.lit(False)).alias("blocked"))).alias("last"))
            .select("level", "pattern", "valid_from", "last.blocked"))


def judge(captures: DataFrame, entries: DataFrame, slice_seconds: int = SLICE_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Captures ``(id, url, at)`` with ``blocked``, the deciding ``kind`` and ``pattern``, and ``valid_from`` of its entry.

    A null or unreadable URL fits no pattern, and a null time no interval: both are allowed with null details.
    Entries without pattern or time, or of another kind, are no entries.  Repeated captures come out as often as they
    went in; empty tables are fine; other columns are not read.
    """
    step = slice_seconds * 1_000_000
    same = captures.groupBy("id", "url", "at").agg(F.count("*").alias("copies"))
    asked = (same.where("at is not null").select("id", "url", "at", F.explode(url_patterns(F.col("url"))).alias("p"))
             .select("id", "url", "at", "p.*"))
    # captures and entries of a pattern on one line of time
    log = logged(entries).select("level", "pattern", F.col("valid_from").alias("t"), F.struct("valid_from", "blocked").alias("entry"))
    looked = asked.select("level", "pattern", F.col("at").alias("t"), F.struct("id", "url", "at", "depth").alias("capture"))
    line = (log.withColumn("capture", F.lit(None).cast(looked.schema["capture"].dataType))
            .unionByName(looked.withColumn("entry", F.lit(None).cast(log.schema["entry"].dataType)))
            .withColumn("slice", F.floor(F.unix_micros("t") / step)))
    # a slice with too many rows is cut into pieces of equal length
    busy = (line.groupBy("level", "pattern", "slice").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("pieces")).where("pieces > 1"))
    piece = F.floor((F.unix_micros("t") - F.col("slice") * step) / step * F.coalesce("pieces", F.lit(1)))
    line = line.join(busy, ["level", "pattern", "slice"], "left").withColumn("piece", piece).drop("pieces")
    # one row per piece: its captures and its last entry; the entry valid at its start is the last one of the pieces before
    key = ["level", "pattern", "slice", "piece"]
    heads = line.groupBy(*key).agg(F.count("capture").alias("asking"), F.max("entry").alias("last"))
    earlier = Window.partitionBy("level", "pattern").orderBy("slice", "piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*key, F.ceil(F.col("asking") / slice_rows).cast("int").alias("salts"), F.last("last", ignorenulls=True).over(earlier).alias("entry"))
    reaching = (heads.where("salts > 0 and entry is not null").select(
        *key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("entry.valid_from").alias("t"), "entry"))
    # captures of one moment cannot be cut by time: a piece that still holds too many is salted, its entries stand with every salt
    line = line.join(heads.where("salts > 1").select(*key, "salts"), key, "left")
    own = F.pmod(F.xxhash64("capture"), F.coalesce("salts", F.lit(1))).cast("int")
    line = line.withColumn("salt", F.explode(F.when(F.col("capture").isNotNull(), F.array(own))
                                             .otherwise(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))).drop("salts")
    both = line.unionByName(reaching, allowMissingColumns=True)
    # an interval is valid from its entry to the next one on the line
    before = Window.partitionBy(*key, "salt").orderBy("t", F.col("capture").isNotNull())
    valid = both.withColumn("entry", F.last("entry", ignorenulls=True).over(before)).where("capture is not null and entry is not null")
    decided = (valid.groupBy("capture.id", "capture.url", "capture.at")
               .agg(F.max(F.struct("level", "capture.depth", "pattern", "entry.valid_from", "entry.blocked")).alias("d")))
    a, d = same.alias("a"), decided.alias("d")
    on = F.col("a.id").eqNullSafe(F.col("d.id")) & F.col("a.url").eqNullSafe(F.col("d.url")) & F.col("a.at").eqNullSafe(F.col("d.at"))
    return a.join(d, on, "left").select(
        "a.id", "a.url", "a.at", F.coalesce("d.d.blocked", F.lit(False)).alias("blocked"),
        F.when(F.col("d.d").isNotNull(), F.coalesce(*[F.when(F.col("d.d.level") == n, k) for n, k in enumerate(KINDS)])).alias("kind"), F.col("d.d.pattern").alias("pattern"),
        F.col("d.d.valid_from").alias("valid_from"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("a.copies"))).alias("copy")).drop("copy")


def derived_captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture; its fetch time follows from its id, within the 30 days of the events."""
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=(F.col("page_id") * 7919 % 43200).cast("int"))
    return pages.select(F.col("page_id").alias("id"), "url", at.alias("at"))


def derived_entries(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Every event as a dated list entry on the prefix, host or domain of one of the pages."""
    n = pages.agg((F.max("page_id") + 1).alias("n"))
    host, segment = url_host(F.col("url")), url_first_segment(F.col("url"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 3 + 1).cast("int"))
    domain = F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]+\.", "")).otherwise(host)
    dated = events.crossJoin(F.broadcast(n)).select("event_id", "user_id", "event_type", "ts", (F.col("event_id") % F.col("n")).alias("page_id"))
    return dated.join(pages.select("page_id", "url"), "page_id").select(
        kind.alias("kind"), F.when(F.col("user_id") % 3 == 0, domain).when((F.col("user_id") % 3 == 1) | (segment == ""), host)
        .otherwise(F.concat(host, F.lit("/"), segment)).alias("pattern"),
        F.col("event_type").isin("error", "purchase").alias("blocked"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("entry_id"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    found = judge(derived_captures(pages), derived_entries(read(spark, sf_dir, "events"), pages))
    return found.select(F.col("id").alias("page_id"), F.coalesce(F.unix_micros("at"), F.lit(-1)).alias("fetched_us"), F.col("blocked").cast("int").alias("blocked"),
                        "kind", "pattern", F.unix_micros("valid_from").alias("valid_from_us"))


SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id * 7919 % 43200) AS tm FROM pages),
e0 AS (
  SELECT e.event_id, e.ts::TIMESTAMP AS tm, e.event_type IN ('error', 'purchase') AS blocked, e.user_id % 3 AS level,
         CASE WHEN e.user_id % 3 = 0 THEN CASE WHEN len(string_split(p.host, '.')) > 2 THEN regexp_replace(p.host, '^[^.]+\.', '') ELSE p.host END
              WHEN e.user_id % 3 = 1 OR p.seg = '' THEN p.host ELSE p.host || '/' || p.seg END AS pattern
  FROM events e JOIN p ON p.page_id = e.event_id % (SELECT max(page_id) + 1 FROM pages)),
e1 AS (SELECT level, lower(pattern) AS pattern, tm AS valid_from, arg_max(blocked, event_id) AS blocked FROM e0 GROUP BY ALL),
e AS (SELECT *, lead(valid_from) OVER (PARTITION BY level, pattern ORDER BY valid_from) AS valid_to FROM e1),
k AS (
  SELECT page_id, url, tm, 0 AS level, len(string_split(host, '.')) - i + 1 AS depth, list_aggregate(string_split(host, '.')[i:], 'string_agg', '.') AS pattern
  FROM p, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) t(i) WHERE host <> ''
  UNION ALL SELECT page_id, url, tm, 1, 0, host FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, tm, 2, 0, host || '/' || seg FROM p WHERE host <> '' AND seg <> ''),
m AS (
  SELECT k.page_id, k.url, k.tm, k.level, k.pattern, e.valid_from, e.blocked,
         row_number() OVER (PARTITION BY k.page_id, k.url, k.tm ORDER BY k.level DESC, k.depth DESC) AS nth
  FROM k JOIN e ON e.level = k.level AND e.pattern = k.pattern AND e.valid_from <= k.tm AND (e.valid_to IS NULL OR k.tm < e.valid_to))
SELECT p.page_id, coalesce(epoch_us(p.tm), -1) AS fetched_us, CAST(coalesce(m.blocked, false) AS INTEGER) AS blocked,
       CASE m.level WHEN 0 THEN 'domain' WHEN 1 THEN 'host' WHEN 2 THEN 'prefix' END AS kind, m.pattern, epoch_us(m.valid_from) AS valid_from_us
FROM p LEFT JOIN m ON m.nth = 1 AND m.page_id = p.page_id AND m.url = p.url AND m.tm = p.tm
"""
