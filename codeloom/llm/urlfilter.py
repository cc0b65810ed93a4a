"""Operator 10, URL filters by a temporal list join, in DataFrame functions only.

A filter list is a log of dated entries: on a date a rule for a host, or for a
domain and all below it, starts to block or stops. Entries become validity
intervals; an as-of join finds, for every capture, the rules of its host and
of the domains above it that were in force when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stash

#: Time buckets that the captures' span is cut into, and salts of a (rule, bucket) key.
BUCKETS, SALTS = 32, 8
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and trailing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"\.+$", "")


def suffixes(of: Column) -> Column:
    """The host and each domain above it."""
    parts = F.split(of, r"\.")
    return F.when(of == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (rule, since, until) of the blocking entries.

    entries: rule (a domain), day (long), action ('block' or 'allow'). A
    rule's entry holds from its day until the rule's next entry's day; of
    entries of one rule and day the allowing one counts. until is null where
    none follows. Entries with a null in any of the three are left out.
    """
    e = entries.where("rule is not null and day is not null and action in ('block', 'allow')").select(F.lower("rule").alias("rule"), F.col("day").cast("long").alias("since"), "action")
    e = e.groupBy("rule", "since").agg(F.min("action").alias("action"))
    return e.withColumn("until", F.lead("since").over(Window.partitionBy("rule").orderBy("since"))).where("action = 'block'").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture with the rules in force at its fetch: the captures' columns page_id, url, fetch_day, and host, n_rules, rule, listed_day, blocked.

    n_rules counts the blocking rules of the host and of domains above it that
    are active on fetch_day; rule is the longest of them and listed_day when
    it came into force (null if none). A null or unreadable url has an empty
    host and is not blocked, as is a capture without fetch_day; rows that
    repeat stay; an empty table gives no rows.

    Captures and intervals meet on (domain, time bucket, salt): an interval is
    copied to the buckets it spans within the captures' time and to the salts,
    so the rows of a host with a third of all captures are dealt to
    BUCKETS * SALTS keys. Only narrow columns are shuffled.
    """
    own = captures.select("page_id", "url", F.col("fetch_day").cast("long").alias("fetch_day")).withColumn("host", host(F.col("url"))).withColumn("row", F.monotonically_increasing_id())
    own = stash(own)
    r = own.agg(F.min("fetch_day").alias("a"), F.max("fetch_day").alias("b")).first()
    first, last = (r.a or 0), (r.b or 0)
    width = max(1, -(-(last - first + 1) // BUCKETS))
    bucket = lambda day: F.floor((day - F.lit(first)) / F.lit(width)).cast("long")
    spans = intervals(entries)
    since, until = F.greatest(F.col("since"), F.lit(first)), F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))
    spans = spans.where(since <= until)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(since), bucket(until))))
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    looked = own.where("fetch_day is not null").select("row", "fetch_day", F.explode(suffixes(F.col("host"))).alias("rule"))
    looked = looked.withColumn("bucket", bucket(F.col("fetch_day"))).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    hit = looked.join(spans, ["rule", "bucket", "salt"]).where((F.col("fetch_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetch_day") < F.col("until"))))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "since"))
    found = hit.groupBy("row").agg(F.count("*").alias("n_rules"), best.alias("best"))
    out = own.join(found, "row", "left")
    return out.select("page_id", "url", "fetch_day", "host", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.col("best.rule").alias("rule"), F.col("best.since").alias("listed_day"), F.col("n_rules").isNotNull().alias("blocked"))
