"""URL filters as a temporal list join.

Dated list entries (key, since, action) become validity intervals: an entry holds until the next dated entry of its
key. A capture asks for its host, every parent domain and every path prefix below its host; an as-of join finds the
entries active when it was fetched: a key's intervals are one row, of which at most one interval holds the fetch date,
so the join gives no more rows than a capture has keys, however long a key's history. Only DataFrame operations are used; a hot
host is split by adaptive execution's skew join, and the list is broadcast only where Spark knows it to be small.

Keys: ``example.com`` covers that host and all below it; ``example.com/a`` covers that path and all below it.

Defined cases: a capture with a null or host-less URL or a null date matches nothing; host names are compared in
lower case without user, port and dots at the end, in URLs and in keys, and IPv6 addresses in their
brackets, with no parent domain; a user ends at the last @ before the path; paths are compared as they are; entries with a null key, date or action are ignored; of entries of one key and
date ``block`` wins; repeated captures are judged one by one; empty tables give no matches or an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import materialise


def host_of(url: Column) -> Column:
    """Lower-case host without user and port, an IPv6 address in its brackets; the empty string if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path without query, fragment and slash at the end."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def candidate_keys(url: Column) -> Column:
    """Keys whose entries cover the URL: parent domains and path prefixes."""
    host = host_of(url)
    # An address in brackets has no parent domain.
    labels, parts = F.when(F.substring(host, 1, 1) == "[", F.array(host)).otherwise(F.split(host, r"\.")), F.split(path_of(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    deeper = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(host_of(url), F.array_join(F.slice(parts, 1, i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, deeper)))


def entry_key(key: Column) -> Column:
    """The key as captures ask for it: host in lower case without dots at its end, path as it is, without slashes at its end."""
    host = F.regexp_replace(F.lower(F.regexp_extract(key, r"^(?:[^/]*@)?(\[[^\]/]*\]|[^/:]*)", 1)), r"\.+$", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(key, "^[^/]*(.*)$", 1), "/+$", ""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, spans): the key's blocking intervals (since, until), ascending; ``until`` is null while the entry still holds.

    One row a key; its spans are no more than the dates on which it was listed.
    """
    dated = (
        entries.select(entry_key(F.col("key")).alias("key"), F.col("since").cast("date").alias("since"), "action")
        .where("key IS NOT NULL AND since IS NOT NULL AND action IS NOT NULL")
        .groupBy("key", "since").agg(F.max("action").alias("action"))
    )
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    spans = F.array_sort(F.collect_list(F.struct("since", "until")))
    return dated.withColumn("until", until).where("action = 'block'").groupBy("key").agg(spans.alias("spans"))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched") -> DataFrame:
    """(id, url, fetched, blocked, rule, listed_since) of every capture; the longest active key is the rule."""
    narrow = materialise(
        captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{date_col}`").cast("date").alias("fetched"))
        .withColumn("row", F.monotonically_increasing_id()),
        "captures",
    )
    asked = narrow.where("fetched IS NOT NULL").select("row", "fetched", F.explode(candidate_keys(F.col("url"))).alias("key"))
    held = F.filter("spans", lambda s: (s["since"] <= F.col("fetched")) & (s["until"].isNull() | (F.col("fetched") < s["until"])))
    active = asked.join(validity_intervals(entries), "key").withColumn("since", F.get(held, 0)["since"]).where("since IS NOT NULL")
    best = active.groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "since")).alias("best"))
    return narrow.join(best, "row", "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(date_col),
        F.col("best").isNotNull().alias("blocked"), F.col("best.key").alias("rule"), F.col("best.since").alias("listed_since"),
    )
