"""URL filter by dated lists: entries become validity intervals, joined as of each capture's fetch time.

The entries of a list for one host or domain, in order of time, say when it is on the list: from an `add` until
the next entry. A capture is on a list if an interval of its host or of a parent domain holds the time it was
fetched. Intervals are dealt to spans of `bucket_days`, and the join is by domain and span, so a capture meets
only intervals near its time however long a domain's history is; Spark can split a frequent host's rows.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower
from millrace.sources.shared import table


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null if there is none."""
    return F.nullif(ascii_lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains, down to two labels; a host of one label itself."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until): from each add up to the next entry of its list and domain; until is null if open.

    Of entries of one time the last by action counts, so a `remove` outweighs an `add`. Rows with a null are passed
    over, repeated rows count once.
    """
    e = entries.select("list", ascii_lower(F.col("domain")).alias("domain"), "action", "at").na.drop()
    last = e.groupBy("list", "domain", "at").agg(F.max("action").alias("action"))
    return last.withColumn("until", F.lead("at").over(W.partitionBy("list", "domain").orderBy("at"))).where("action = 'add'").select("list", "domain", F.col("at").alias("since"), "until")


def listed(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", bucket_days: int = 32) -> DataFrame:
    """One row per row of captures: the id column, time column, host, n_active, lists, domain, listed_since.

    entries: list, domain, action ('add' or 'remove'), at (date or timestamp, as the time column). n_active counts the
    pairs of list and domain that hold the capture; lists are distinct, sorted, comma-joined ('' for none); domain is
    the longest listed one and listed_since the earliest start, null for none. A null or odd URL and a null time are on no list.
    Null and repeated ids are rows of their own. Empty tables give no rows or no lists. Other columns are ignored.
    """

    def span(t: Column) -> Column:
        return F.floor(F.unix_date(F.to_date(t)) / bucket_days).cast("long")

    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(time_col).alias("time"), host_of(F.col(url_col)).alias("host"))
    # Written, without the rest of the captures, as the numbers are used twice.
    rows = table(rows)
    asked = rows.where(F.col("time").isNotNull() & F.col("host").isNotNull()).select("row", "time", F.explode(domains_of(F.col("host"))).alias("domain"), span(F.col("time")).alias("span"))
    spans = table(asked.select("domain", "span").distinct())
    intervals = validity(entries).withColumn("from", span(F.col("since"))).withColumn("to", span(F.col("until")))
    within = (F.col("span") >= F.col("from")) & (F.col("to").isNull() | (F.col("span") <= F.col("to")))
    dealt = intervals.join(spans, "domain").where(within).select("list", "domain", "since", "until", "span")
    held = asked.join(dealt, ["domain", "span"]).where((F.col("since") <= F.col("time")) & (F.col("until").isNull() | (F.col("time") < F.col("until"))))
    found = held.groupBy("row").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.max_by("domain", F.struct(F.length("domain"), "domain")).alias("domain"),
        F.min("since").alias("listed_since"),
    )
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), F.col("time").alias(time_col), "host", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "domain", "listed_since"
    )
