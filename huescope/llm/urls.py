"""URL filters by dated lists: each capture is judged by the entries in force when it was fetched.

List entries are events (kind, key, since, action): from `since` on, `action` ("block" or "allow") holds for
what the key names, until the next entry of the same kind and key. They become validity intervals by a
window over each key's events; a capture's own keys - its URL without scheme, query and fragment, and its host
with every parent domain - meet them in an equi-join on (kind, key) within the interval: an as-of join.
Of the entries in force, a URL's goes before a host's and a longer host's before a shorter one's.

The list is joined by broadcast only while it has at most BROADCAST rows, else by a shuffle whose hot hosts
adaptive execution splits. Nulls: a null or unparsable URL has no keys and is kept; a null fetch time meets no
entry; entries without key, kind or date are left out. Entries that agree in kind, key and date: "allow" wins. Very long URLs are keyed
whole. Repeated captures are judged alike, each a row; an empty list keeps all captures, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, whole_row

BROADCAST = 100_000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """The host, A-Z lower-cased, without user, port and closing dot; empty where there is none."""
    return _lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def bare(url: Column) -> Column:
    """Host and path."""
    return F.concat(host(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, action, since, until: one row an entry; until is the next entry's date, null for the last."""
    good = entries.filter("kind is not null and key is not null and since is not null and action is not null")
    one = good.groupBy("kind", "key", "since").agg(F.min("action").alias("action"))
    return one.withColumn("until", F.lead("since").over(Window.partitionBy("kind", "key").orderBy("since")))


RESULT = ("host", "entry_kind", "entry_key", "since", "action", "kept")


def judge(captures: DataFrame, entries: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """captures (url, fetched and more) with host, entry_kind, entry_key, since, action and kept; own columns of these names are left out."""
    valid = intervals(entries)
    listed = F.broadcast(valid) if small(entries, broadcast) else valid
    named = captures.select(whole_row(captures), "url", "fetched", host(F.col("url")).alias("host"))
    labels = F.split(F.col("host"), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), i.alias("place")))
    page = F.array(F.struct(F.lit("url").alias("kind"), bare(F.col("url")).alias("key"), F.lit(0).alias("place")))
    keyed = named.filter("host != ''").select("url", "fetched").distinct().select("url", "fetched", host(F.col("url")).alias("host")).select("url", "fetched", F.explode(F.concat(page, domains)).alias("k")).select("url", "fetched", "k.*")
    met = keyed.join(listed, ["kind", "key"]).filter("fetched >= since and (until is null or fetched < until)")
    first = met.groupBy("url", "fetched").agg(F.min(F.struct("place", "kind", "key", "since", "action")).alias("e"))
    out = named.join(first, ["url", "fetched"], "left")
    own = [F.col("row").getField(c).alias(c) for c in captures.columns if c not in RESULT]
    return out.select(*own, "host", F.col("e.kind").alias("entry_kind"), F.col("e.key").alias("entry_key"), F.col("e.since").alias("since"), F.col("e.action").alias("action"), F.coalesce(F.col("e.action") != "block", F.lit(True)).alias("kept"))
