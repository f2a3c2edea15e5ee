"""URL filters with dated lists: list entries become validity intervals, an as-of join finds those active at fetch time.

A list is a table of changes (``kind``, ``value``, ``action``, ``listed_on``): an ``add`` opens an interval that the entry's
next change ends. Kinds are ``host`` (exact), ``domain`` (the host or a parent of it), ``path`` (host and first path segment)
and ``token`` (a run of letters and digits of the host). A capture is blocked if an entry that fits its URL was active on the
day of its fetch, the day of the ``add`` included and the day of the ``remove`` not.

Only DataFrame functions are used. Whether an entry is active is decided once per distinct (kind, value, day), so a hot host
costs a row per day, and a window holds at most the days of one entry. Of several changes of an entry on one day ``add``
wins; repeated changes count once; changes with a null in any column are ignored. Captures without a URL or a fetch day fit
no entry. Repeated captures are decided each alike. Empty tables give no captures, or nothing blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)"
FOREVER = "9999-12-31"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys(url):
    """All (kind, value) pairs an entry can have to fit the URL, without duplicates."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)
    tokens = F.filter(F.split(host, "[^a-z0-9]+"), lambda t: t != "")

    def pairs(kind: str, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(
        pairs("host", F.array(host)), pairs("domain", parents), pairs("path", F.array(F.concat(host, F.lit("/"), segment))), pairs("token", tokens)
    )
    return F.when(host != "", F.array_distinct(found)).otherwise(F.slice(found, 1, 0))


def intervals(changes: DataFrame) -> DataFrame:
    """``kind``, ``value``, ``valid_from`` and ``valid_to`` (exclusive) of every time an entry was on the list."""
    daily = (
        changes.select("kind", "value", F.lower("action").alias("action"), F.col("listed_on").cast("date").alias("listed_on"))
        .dropna()
        .groupBy("kind", "value", "listed_on")
        .agg(F.max(F.col("action") == "add").alias("added"))
    )
    following = F.lead("listed_on").over(W.partitionBy("kind", "value").orderBy("listed_on"))
    return (
        daily.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER).cast("date")))
        .where("added")
        .select("kind", "value", F.col("listed_on").alias("valid_from"), "valid_to")
    )


def active(needs: DataFrame, valid: DataFrame) -> DataFrame:
    """Those of the distinct ``needs`` (kind, value, day) for which an interval is active: an as-of join.

    Per entry, needs and intervals are put in the order of their days, and each need looks back at the last interval begun.
    """
    none = F.lit(None).cast("date")
    both = needs.select("kind", "value", "day", none.alias("valid_from"), none.alias("valid_to")).unionByName(
        valid.select("kind", "value", F.col("valid_from").alias("day"), "valid_from", "valid_to")
    )
    order = W.partitionBy("kind", "value").orderBy("day", F.col("valid_from").isNull())
    end = F.last("valid_to", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("end", end).where(F.col("valid_from").isNull() & (F.col("day") < F.col("end"))).select("kind", "value", "day")


def filtered(captures: DataFrame, changes: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """The captures with ``n_entries`` (active entries that fit), ``entries`` (those, sorted) and ``blocked``."""
    names = [f"c{i}" for i in range(len(captures.columns))]
    plain = captures.toDF(*names)
    url, day = F.col(names[captures.columns.index(url_col)]), F.col(names[captures.columns.index(day_col)]).cast("date")
    distinct = plain.select(url.alias("url"), day.alias("day")).where("url is not null and day is not null").distinct()
    exploded = distinct.select("url", "day", F.explode(keys(F.col("url"))).alias("key")).select("url", "day", "key.kind", "key.value")
    found = active(exploded.select("kind", "value", "day").distinct(), intervals(changes))
    decided = (
        exploded.join(found, ["kind", "value", "day"])
        .groupBy("url", "day")
        .agg(F.array_join(F.sort_array(F.collect_set(F.concat("kind", F.lit(":"), "value"))), ",").alias("entries"), F.count("*").alias("n_entries"))
    )
    keyed = plain.withColumns({"_url": url, "_day": day})
    joined = keyed.join(
        decided.select(F.col("url").alias("_url"), F.col("day").alias("_day"), "entries", "n_entries"), ["_url", "_day"], "left"
    )
    added = [
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("entries", F.lit("")).alias("entries"), F.col("n_entries").isNotNull().alias("blocked"),
    ]
    kept = [n for n in captures.columns if n not in ("n_entries", "entries", "blocked")]
    old = [F.col(names[i]).alias(n) for i, n in enumerate(captures.columns) if n in kept]
    return joined.select(*old, *added)


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages with the day of their fetch, which the table does not give: days of 2023 and 2024 by the page's number."""
    return pages.select("page_id", "url", F.expr("date_add(date'2023-01-01', cast(page_id * 7919 % 730 as int))").alias("fetched_on"))


def changes_of(pages: DataFrame) -> DataFrame:
    """A list of changes for the hosts of ``pages``: some hosts, parents, paths and tokens, listed, taken off and listed again.

    The entries follow from the least page number of each host, so the list grows with the hosts of the table.
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.min("page_id").alias("k"))
    entries = hosts.selectExpr(
        "k",
        """explode(array(
            if(k % 5 = 0, struct('host' as kind, host as value), null),
            if(k % 31 = 0, struct('domain' as kind, substring_index(host, '.', -2) as value), null),
            if(k % 7 = 0, struct('path' as kind, host || '/en' as value), null),
            if(k % 11 = 0, struct('token' as kind, regexp_extract(host, '^([a-z0-9]+)', 1) as value), null)
        )) as entry""",
    ).where("entry is not null")
    return entries.selectExpr(
        "entry.kind as kind", "entry.value as value",
        """explode(array(
            struct('add' as action, date_add(date'2023-01-01', cast(k * 37 % 500 as int)) as listed_on),
            struct('remove' as action, date_add(date'2023-01-01', cast(k * 37 % 500 + 20 + k % 90 as int)) as listed_on),
            struct('add' as action, date_add(date'2023-01-01', cast(k * 37 % 500 + 150 + k % 70 as int)) as listed_on)
        )) as change""",
    ).select("kind", "value", "change.action", "change.listed_on")


def report(pages: DataFrame) -> DataFrame:
    return filtered(captures_of(pages), changes_of(pages)).withColumn("fetched_on", F.col("fetched_on").cast("string"))


#: The same by comparing every capture with every interval of its keys.
SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 7919 % 730 AS INTEGER) AS fetched_on,
         lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment,
         row_number() OVER () AS n
  FROM pages),
hosts AS (SELECT host, min(page_id) AS k FROM captures WHERE host <> '' GROUP BY host),
entries AS (
  SELECT k, 'host' AS kind, host AS value FROM hosts WHERE k % 5 = 0
  UNION ALL SELECT k, 'domain', regexp_extract(host, '([^.]*\.)?[^.]*$', 0) FROM hosts WHERE k % 31 = 0
  UNION ALL SELECT k, 'path', host || '/en' FROM hosts WHERE k % 7 = 0
  UNION ALL SELECT k, 'token', regexp_extract(host, '^([a-z0-9]+)', 1) FROM hosts WHERE k % 11 = 0),
changes AS (
  SELECT kind, value, 'add' AS action, DATE '2023-01-01' + CAST(k * 37 % 500 AS INTEGER) AS listed_on FROM entries
  UNION ALL SELECT kind, value, 'remove', DATE '2023-01-01' + CAST(k * 37 % 500 + 20 + k % 90 AS INTEGER) FROM entries
  UNION ALL SELECT kind, value, 'add', DATE '2023-01-01' + CAST(k * 37 % 500 + 150 + k % 70 AS INTEGER) FROM entries),
daily AS (SELECT kind, value, listed_on, bool_or(action = 'add') AS added FROM changes GROUP BY ALL),
valid AS (
  SELECT * FROM (
    SELECT kind, value, listed_on AS valid_from, added,
           coalesce(lead(listed_on) OVER (PARTITION BY kind, value ORDER BY listed_on), DATE '9999-12-31') AS valid_to
    FROM daily) WHERE added),
labels AS (SELECT n, host, string_split(host, '.') AS parts FROM captures WHERE host <> ''),
keys AS (
  SELECT n, 'host' AS kind, host AS value FROM captures WHERE host <> ''
  UNION SELECT n, 'domain', array_to_string(parts[i:], '.') FROM (SELECT n, parts, unnest(range(1, len(parts) + 1)) AS i FROM labels)
  UNION SELECT n, 'path', host || '/' || segment FROM captures WHERE host <> ''
  UNION SELECT n, 'token', token FROM (SELECT n, unnest(regexp_split_to_array(host, '[^a-z0-9]+')) AS token FROM labels) WHERE token <> ''),
fitting AS (
  SELECT DISTINCT n, kind || ':' || keys.value AS entry
  FROM keys JOIN captures USING (n) JOIN valid USING (kind, value)
  WHERE fetched_on >= valid_from AND fetched_on < valid_to),
decided AS (SELECT n, string_agg(entry, ',' ORDER BY entry) AS entries, count(*) AS n_entries FROM fitting GROUP BY n)
SELECT page_id, url, CAST(fetched_on AS VARCHAR) AS fetched_on, coalesce(n_entries, 0) AS n_entries, coalesce(entries, '') AS entries, n_entries IS NOT NULL AS blocked
FROM captures LEFT JOIN decided USING (n)
"""
