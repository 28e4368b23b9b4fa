"""URL filters: captures against dated lists, as the lists stood at fetch time.

List entries are dated events (a key is added or removed). Per list and key they become
validity intervals, closed on the left. Every capture is looked up under each key that could
list it (its host and all parent domains; its host with each path prefix, the empty one too), and an as-of join
keeps the entries whose interval holds the fetch date. The interval side has few rows a key,
and the capture side is what may be skewed, so the join is an equi-join on the key with a range
condition: a hot host's captures can be split over tasks, and no key's rows are gathered.

A capture whose URL is null or has no host matches nothing; one without a date matches nothing.
Of events of one key and date the removal wins. An addition while the key is listed, or a
removal while it is not, changes nothing. Repeated captures give repeated rows; columns other
than page_id, url and fetched are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"
OPEN_END = "9999-12-31"


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until of entries (list, key, action, day); until is exclusive."""
    one = entries.groupBy("list", "key", "day").agg(F.min(F.col("action") != "remove").alias("listed"))
    by_key = Window.partitionBy("list", "key").orderBy("day")
    changes = one.withColumn("before", F.lag("listed", 1, False).over(by_key)).where(F.col("listed") != F.col("before"))
    return changes.withColumn("until", F.lead("day").over(by_key)).where("listed").select("list", "key", F.col("day").alias("since"), F.coalesce("until", F.lit(OPEN_END).cast("date")).alias("until"))


def keys(url: Column, single_labels: bool = True) -> Column:
    """All keys that could list a URL: "domain:..." of its host and parents, "prefix:..." of its paths, from "prefix:host/" on.

    Without single_labels, top-level domains of longer hosts are left out.
    """
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels) if single_labels else F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.array_remove(F.split(F.regexp_extract(F.lower(url), PATH, 1), "/"), "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat(F.lit("prefix:"), host(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.when(host(url) != "", F.array_distinct(F.concat(domains, prefixes)))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, n_entries, lists, blocked of captures (page_id, url, fetched) against dated entries.

    Matches are found for each different (url, fetched), so what is joined back has one row a pair.
    """
    captures = captures.select("page_id", "url", "fetched")
    active = materialise(intervals(entries), "intervals")
    # every capture has a top-level domain, so those are looked for only if a list holds one
    single_labels = not active.where(~F.col("key").contains(".")).isEmpty()
    probes = captures.where(F.col("url").isNotNull() & F.col("fetched").isNotNull()).select("url", "fetched").distinct().select("url", "fetched", F.explode(keys(F.col("url"), single_labels)).alias("key"))
    hits = probes.alias("p").join(active.alias("a"), (F.col("p.key") == F.col("a.key")) & (F.col("fetched") >= F.col("since")) & (F.col("fetched") < F.col("until")))
    found = hits.select("url", "fetched", "list", "p.key").distinct().groupBy("url", "fetched").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    found = materialise(found.withColumnsRenamed({"url": "_url", "fetched": "_fetched"}), "matches")
    joined = captures.join(found, (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_fetched")), "left")
    return joined.select("page_id", "url", "fetched", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("blocked"))


# --- the query's captures and lists, by rule from the pages ---


def captures_of(pages: DataFrame) -> DataFrame:
    """A page's fetch date: one of the 366 days from 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries for a third of the hosts and of their first path steps, chosen by MD5."""
    start = F.lit("2024-01-01").cast("date")

    def digits(key: Column, at: int, n: int) -> Column:
        return F.conv(F.substring(F.md5(key), at, n), 16, 10).cast("int")

    def events(key: Column, name: str) -> Column:
        add = digits(key, 3, 3) % 300
        days = ((0, "add"), (1 + digits(key, 6, 2), "remove"), (200 + digits(key, 8, 2), "add"))
        return F.array(*(F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), F.date_add(start, add + later).alias("day")) for later, action in days))

    domain = F.concat(F.lit("domain:"), host(F.col("url")))
    step = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    prefix = F.concat(F.lit("prefix:"), host(F.col("url")), F.lit("/"), step)
    listed = pages.where(host(F.col("url")) != "").select(F.explode(F.array(F.struct(domain.alias("key"), F.lit("hosts").alias("list")), F.struct(prefix.alias("key"), F.lit("paths").alias("list")))).alias("x")).select("x.key", "x.list").distinct()
    chosen = listed.where(digits(F.col("key"), 1, 2) % 3 == 0)
    return chosen.select(F.inline(F.when(F.col("list") == "hosts", events(F.col("key"), "hosts")).otherwise(events(F.col("key"), "paths"))))


SQL = rf"""
WITH p AS (SELECT page_id, url, (DATE '2024-01-01' + (page_id % 366)::INT)::DATE AS fetched, regexp_extract(lower(url), '{HOST}', 1) AS host,
  regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS step, regexp_extract(lower(url), '{PATH}', 1) AS path FROM pages),
k AS (SELECT DISTINCT 'domain:' || host AS key, 'hosts' AS list FROM p WHERE host <> '' UNION SELECT DISTINCT 'prefix:' || host || '/' || step, 'paths' FROM p WHERE host <> ''),
d AS (SELECT key, list, DATE '2024-01-01' + ('0x' || md5(key)[3:5])::INT % 300 AS a1, ('0x' || md5(key)[6:7])::INT + 1 AS x, 200 + ('0x' || md5(key)[8:9])::INT AS y
  FROM k WHERE ('0x' || md5(key)[1:2])::INT % 3 = 0),
e AS (SELECT list, key, true AS listed, a1::DATE AS day FROM d UNION ALL SELECT list, key, false, (a1 + x)::DATE FROM d UNION ALL SELECT list, key, true, (a1 + y)::DATE FROM d),
o AS (SELECT list, key, day, bool_and(listed) AS listed FROM e GROUP BY ALL),
c AS (SELECT *, lag(listed, 1, false) OVER (PARTITION BY list, key ORDER BY day) AS before FROM o),
i AS (SELECT * FROM (SELECT list, key, listed, day AS since, lead(day, 1, DATE '{OPEN_END}') OVER (PARTITION BY list, key ORDER BY day) AS until FROM c WHERE listed <> before) WHERE listed),
s AS (SELECT DISTINCT url, fetched, host, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM p WHERE host <> ''),
q AS (SELECT url, fetched, 'domain:' || array_to_string(labels[n:], '.') AS key FROM s, range(1, 200) r(n) WHERE n <= len(labels)
  UNION SELECT url, fetched, 'prefix:' || host || '/' || array_to_string(steps[:n], '/') FROM s, range(0, 200) r(n) WHERE n <= len(steps)),
m AS (SELECT url, fetched, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM q JOIN i ON q.key = i.key AND fetched >= since AND fetched < until GROUP BY ALL)
SELECT page_id, url, fetched, coalesce(n, 0)::BIGINT AS n_entries, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM p LEFT JOIN m USING (url, fetched)
"""
