"""URL filters as a temporal join; DataFrame functions only.

A list is a log of dated entries (add or remove a key). Entries of one day are
reduced to the last one, and consecutive days become validity intervals
``[valid_from, valid_to)``. A capture has candidate keys: its host, every parent
domain and every path prefix. An as-of join finds, per list and key, the one
interval that holds the capture's fetch day: intervals are spread over the months
they touch, so the join is an equi-join on (kind, key, month) with a range
condition on few rows. Keys are salted besides: a host with a third of all
captures is split over months and salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terminus.llm.common import table

SALTS = 8
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; empty for anything else."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def segments_of(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda s: s != "")


def validity(entries: DataFrame) -> DataFrame:
    """``entries(list, verdict, kind, key, action, effective, seq)`` -> intervals
    ``list, verdict, kind, key, valid_from, valid_to`` (null: still valid).

    Of one day's entries of a key the one with the largest seq counts (of equal
    ones the removal). Entries without list, kind, key or day are ignored.
    """
    day = (entries.filter("list is not null and kind is not null and key is not null and effective is not null")
           .groupBy("list", "kind", "key", F.col("effective").cast("date").alias("valid_from"))
           .agg(F.max(F.struct("seq", "action", "verdict")).alias("last")))
    history = Window.partitionBy("list", "kind", "key").orderBy("valid_from")
    return (day.withColumn("valid_to", F.lead("valid_from").over(history)).filter("last.action = 'add'")
            .select("list", F.col("last.verdict").alias("verdict"), "kind", "key", "valid_from", "valid_to"))


def candidates(url: Column) -> Column:
    """Array of (kind, key, specificity): parent domains, the host, path prefixes."""
    host, segments = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domain = F.transform(F.when(n >= 3, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.concat_ws(".", F.slice(labels, i, n - i + 1)).alias("key"),
        (n - i + 1).alias("specificity")))
    whole = F.array(F.struct(F.lit("domain").alias("kind"), host.alias("key"), n.alias("specificity")),
                    F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(1000).alias("specificity")))
    paths = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(segments, 1, i))).alias("key"),
                           (i + 1000).alias("specificity")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,key:string,specificity:int>>")).otherwise(
        F.concat(domain, whole, paths))


def evaluate(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """``captures(page_id, url, fetched, ..)`` -> one row per capture: ``page_id,
    url, fetched, verdict, list, kind, key, valid_from, valid_to``.

    Of all entries active on the fetch day the most specific wins (longer path
    prefix, then host, then longer domain); between equals ``allow`` wins, then
    the last list by name. Without one the verdict is ``none`` and the rest null.
    Captures without host or fetch day match nothing. Repeated captures and null
    page_ids are evaluated alike. Only the named columns are read. Empty tables
    give no captures, or captures without matches.
    """
    rows = captures.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                           F.col("fetched").cast("date").alias("fetched"))
    month = lambda d: F.trunc(d, "month")
    latest = rows.agg(F.max("fetched").alias("latest"))
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("latest")), F.col("latest"))
    spans = (validity(entries).join(F.broadcast(latest), F.col("valid_from") <= F.col("latest"))  # one row
             .withColumn("month", F.explode(F.sequence(month(F.col("valid_from")), month(until), F.expr("interval 1 month"))))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("latest"))
    asked = (rows.filter("fetched is not null").distinct()
             .select("page_id", "url", "fetched", F.inline(candidates(F.col("url"))))
             .withColumn("month", month(F.col("fetched")))
             .withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")))
    hits = asked.join(spans, ["kind", "key", "month", "salt"]).filter(
        (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    best = (hits.groupBy("page_id", "url", "fetched")
            .agg(F.max(F.struct("specificity", (F.col("verdict") == "allow").alias("open"), "list", "verdict", "kind", "key",
                                "valid_from", "valid_to")).alias("b"))
            .select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched").alias("_f"), "b"))
    same = F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & (F.col("fetched") == F.col("_f"))
    return rows.join(best, same, "left").select(
        "page_id", "url", "fetched", F.coalesce("b.verdict", F.lit("none")).alias("verdict"),
        *[F.col(f"b.{c}").alias(c) for c in ("list", "kind", "key", "valid_from", "valid_to")])


# The tables have neither fetch days nor lists: both follow from the pages.

def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 730).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries for every host, domain and first path segment of the pages."""
    pages = table(spark, sf_dir, "pages").select(
        host_of(F.col("url")).alias("host"), F.element_at(F.concat(segments_of(F.col("url")), F.array(F.lit(""))), 1).alias("first"))
    pages = pages.filter("host <> ''")
    h = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 7), 16, 10).cast("bigint")
    keys = (pages.select(F.lit("host").alias("kind"), F.col("host").alias("key"))
            .union(pages.select(F.lit("domain"), F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)))
            .union(pages.filter("first <> ''").select(F.lit("path"), F.concat("host", F.lit("/"), "first")))
            .filter("key <> ''").distinct().withColumn("h", h(F.col("key"))))
    entry = lambda name, verdict, action, day, when: F.when(when, F.struct(
        F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), day.alias("day")))
    k, n = F.col("kind"), F.col("h")
    log = F.array(
        entry("blocked-hosts", "block", "add", n % 365, (k == "host") & (n % 3 == 0)),
        entry("blocked-hosts", "block", "remove", n % 365 + 90 + n % 60, (k == "host") & (n % 3 == 0)),
        entry("blocked-hosts", "block", "add", n % 365 + 300, (k == "host") & (n % 6 == 0)),
        entry("trusted-domains", "allow", "add", n % 200, k == "domain"),
        entry("trusted-domains", "allow", "remove", n % 200 + 250, k == "domain"),
        entry("blocked-sections", "block", "add", n % 500, (k == "path") & (n % 4 == 0)),
        entry("open-sections", "allow", "add", n % 500 + 50, (k == "path") & (n % 8 == 0)))
    return (keys.select("kind", "key", F.posexplode(log).alias("seq", "e")).filter("e is not null")
            .select("e.list", "e.verdict", "kind", "key", "e.action",
                    F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.day").cast("int")).alias("effective"), "seq"))


def oracle_sql() -> str:
    """The query op4 as DuckDB SQL: no months, no salts, one sorted join."""
    lists = [("blocked-hosts", "block", "add", "h % 365", "kind = 'host' and h % 3 = 0"),
             ("blocked-hosts", "block", "remove", "h % 365 + 90 + h % 60", "kind = 'host' and h % 3 = 0"),
             ("blocked-hosts", "block", "add", "h % 365 + 300", "kind = 'host' and h % 6 = 0"),
             ("trusted-domains", "allow", "add", "h % 200", "kind = 'domain'"),
             ("trusted-domains", "allow", "remove", "h % 200 + 250", "kind = 'domain'"),
             ("blocked-sections", "block", "add", "h % 500", "kind = 'path' and h % 4 = 0"),
             ("open-sections", "allow", "add", "h % 500 + 50", "kind = 'path' and h % 8 = 0")]
    log = "\nunion all ".join(
        f"select '{name}' as list, '{verdict}' as verdict, kind, key, '{action}' as action, "
        f"date '2024-01-01' + cast({day} as integer) as effective, {seq} as seq from k where {when}"
        for seq, (name, verdict, action, day, when) in enumerate(lists))
    return f"""with p as (select page_id, url, date '2024-01-01' + cast(page_id * 7919 % 730 as integer) as fetched,
  lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) as host,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '{PATH}', 1), '/'), lambda s: s <> '') as seg from pages),
k0 as (select 'host' as kind, host as key from p union select 'domain', regexp_extract(host, '([^.]*\\.[^.]*)$', 1) from p
  union select 'path', host || '/' || seg[1] from p where len(seg) > 0 and host <> ''),
k as (select kind, key, cast('0x' || substr(md5(key), 1, 7) as bigint) as h from k0 where key <> ''),
log as ({log}),
day as (select list, kind, key, effective, arg_max(action, seq) as action, arg_max(verdict, seq) as verdict
  from log group by all),
iv as (select *, lead(effective) over (partition by list, kind, key order by effective) as valid_to from day),
c as (select page_id, url, fetched, host, seg, string_split(host, '.') as labels from p where host <> ''),
cand as (select page_id, url, fetched, 'host' as kind, host as key, 1000 as specificity from c
  union all select page_id, url, fetched, 'domain', array_to_string(labels[i:], '.'), len(labels) - i + 1
    from c, lateral (select unnest(range(1, greatest(len(labels), 2))) as i)
  union all select page_id, url, fetched, 'path', host || '/' || array_to_string(seg[1:i], '/'), 1000 + i
    from c, lateral (select unnest(range(1, len(seg) + 1)) as i)),
hit as (select cand.*, list, verdict, effective as valid_from, valid_to, row_number() over (
    partition by page_id order by specificity desc, verdict = 'allow' desc, list desc) as rn
  from cand join iv using (kind, key) where action = 'add' and effective <= fetched
    and (valid_to is null or fetched < valid_to))
select p.page_id, p.url, p.fetched, coalesce(verdict, 'none') as verdict, list, kind, key, valid_from, valid_to
from p left join (select * from hit where rn = 1) h on p.page_id = h.page_id"""
