"""URL filters over time: dated list entries become validity intervals, and every capture meets the entries active when it was fetched.

DataFrame operations only. An entry's key is a host, which covers its subdomains, or a host with the beginning of a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """Validity of entries: list_name, key, kind, since, until (null: still valid), from events list_name, key, kind, action, at.

    An 'add' is valid from its time up to the next event of the same list and key; a 'remove' only ends. Of events at one
    time 'remove' counts last, and among equal actions kind 'allow' before 'block'. Repeated events count once; events without key or time are void.
    """
    order = Window.partitionBy("list_name", "key").orderBy("at", "action", F.col("kind").desc())
    e = events.where("key is not null and at is not null").select("list_name", F.lower("key").alias("key"), "kind", "action", "at").distinct()
    return e.withColumn("until", F.lead("at").over(order)).where("action = 'add' and (until is null or at < until)").select("list_name", "key", "kind", F.col("at").alias("since"), "until")


def url_host(url):
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", "")


def host_keys(host):
    """Keys that may list a host: the host and every parent domain."""
    labels = F.split(host, r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def path_keys(url):
    """Keys that may list a URL by its path: the host with each beginning of the path that ends at a slash or the end. None without a path."""
    steps = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != "")
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.concat(url_host(url), F.lit("/"), F.lower(F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.when(F.size(steps) > 0, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (with url and fetched_at) with blocked, matched_key, matched_list and n_active.

    - The longest key active at fetched_at decides; of equal keys 'allow' wins over 'block', then the first list by name.
    - n_active counts the active entries that cover the URL. Null or unreadable URLs and null times match nothing and aren't blocked.
    - Repeated captures each keep their row. An empty list blocks nothing; no captures give no rows. URLs of any length are taken whole.
    - Columns of the captures with one of the new names are replaced; others stay, whatever their names.

    Domains are looked up once a host and paths only under hosts that an entry with a path names, so no capture is spread over the
    keys of its top-level domain.
    """
    valid = intervals(events)
    own = [c for c in captures.columns if c not in ("blocked", "matched_key", "matched_list", "n_active")]
    # One row a URL and time: repeats and hot URLs are one row before anything is spread over keys.
    seen = captures.select("url", "fetched_at").where("url is not null and fetched_at is not null").distinct().withColumn("host", url_host(F.col("url"))).where("host <> ''")
    wide, deep = valid.where(~F.col("key").contains("/")), valid.where(F.col("key").contains("/"))
    listed = seen.select("host").distinct().withColumn("key", F.explode(host_keys(F.col("host")))).join(wide, "key")
    columns = ["url", "fetched_at", "key", "list_name", "kind", "since", "until"]
    by_host = seen.join(listed, "host").select(*columns)
    rooms = deep.select(F.substring_index("key", "/", 1).alias("host")).distinct()
    by_path = seen.join(rooms, "host", "left_semi").withColumn("key", F.explode(path_keys(F.col("url")))).join(deep, "key").select(*columns)
    active = by_host.union(by_path).where("since <= fetched_at and (until is null or fetched_at < until)")
    rank = F.struct((-F.length("key")).alias("shortness"), "kind", "list_name", "key")
    verdict = active.groupBy("url", "fetched_at").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    c, v = packed(captures, u=captures["url"], f=captures["fetched_at"]).alias("c"), verdict.alias("v")
    return c.join(v, (F.col("c.u") == F.col("v.url")) & (F.col("c.f") == F.col("v.fetched_at")), "left").select(
        *[F.col(f"c.row.`{x}`").alias(x) for x in own], F.coalesce(F.col("v.best.kind") == "block", F.lit(False)).alias("blocked"), F.col("v.best.key").alias("matched_key"),
        F.col("v.best.list_name").alias("matched_list"), F.coalesce("v.n", F.lit(0).cast("long")).alias("n_active"))


def sample_list(pages: DataFrame) -> DataFrame:
    """Dated events by rule, as no table holds a list: hosts enter by their hash, some leave and come back, some only with a path or to be allowed."""
    host = F.lower(F.regexp_extract("url", _URL, 1)).alias("host")
    v = pages.select(host).where("host <> ''").distinct().withColumn("v", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    event = lambda when, key, name, kind, action, day: F.when(when, F.struct(F.lit(name).alias("list_name"), key.alias("key"), F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("at")))
    h, n = F.col("host"), F.col("v")
    events = F.array(
        event(n % 5 == 0, h, "daily", "block", "add", n % 200), event(n % 10 == 0, h, "daily", "block", "remove", n % 200 + 60),
        event(n % 20 == 0, h, "daily", "block", "add", n % 200 + 100), event(n % 7 == 0, F.concat(h, F.lit("/de")), "paths", "block", "add", n % 100),
        event(n % 15 == 0, h, "reviewed", "allow", "add", n % 300), event(h.rlike("spam|pills"), h, "spam", "block", "add", n * 0))
    return v.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*")


def filtered_pages(pages: DataFrame) -> DataFrame:
    """pages as captures, fetched on a day that their id gives, against sample_list."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return filter_urls(pages.select("page_id", "url", day.alias("fetched_at")), sample_list(pages))


SQL = r"""
with p as (select page_id, url, (date '2024-01-01' + (page_id % 366)::int)::date as fetched_at,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)), '.') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2) as path from pages),
h as (select host, ('0x' || substr(md5(host), 1, 4))::int as v from (select distinct host from p where host <> '')),
e as (
  select 'daily' as list_name, host as key, 'block' as kind, 'add' as action, v % 200 as d from h where v % 5 = 0
  union all select 'daily', host, 'block', 'remove', v % 200 + 60 from h where v % 10 = 0
  union all select 'daily', host, 'block', 'add', v % 200 + 100 from h where v % 20 = 0
  union all select 'paths', host || '/de', 'block', 'add', v % 100 from h where v % 7 = 0
  union all select 'reviewed', host, 'allow', 'add', v % 300 from h where v % 15 = 0
  union all select 'spam', host, 'block', 'add', 0 from h where host like '%spam%' or host like '%pills%'),
i as (select list_name, key, kind, since, until from (select list_name, key, kind, action, (date '2024-01-01' + d::int)::date as since,
    lead((date '2024-01-01' + d::int)::date) over (partition by list_name, key order by d, action) as until from e) where action = 'add' and (until is null or since < until)),
u as (select distinct url, fetched_at, host, path from p where url is not null and host <> ''),
k as (
  select url, fetched_at, array_to_string(l[n:], '.') as key from (select url, fetched_at, l, unnest(range(1, len(l) + 1)) as n from (select url, fetched_at, string_split(host, '.') as l from u))
  union select url, fetched_at, host || '/' || lower(array_to_string(s[1:n], '/')) from (select url, fetched_at, host, s, unnest(range(1, len(s) + 1)) as n from (select url, fetched_at, host, list_filter(string_split(path, '/'), lambda x: x <> '') as s from u))),
a as (select k.url, k.fetched_at, i.key, i.kind, i.list_name,
    row_number() over (partition by k.url, k.fetched_at order by length(i.key) desc, i.kind, i.list_name, i.key) as rn, count(*) over (partition by k.url, k.fetched_at) as n
  from k join i on k.key = i.key and i.since <= k.fetched_at and (i.until is null or k.fetched_at < i.until))
select p.page_id, p.url, p.fetched_at, coalesce(a.kind = 'block', false) as blocked, a.key as matched_key, a.list_name as matched_list, coalesce(a.n, 0)::bigint as n_active
from p left join a on p.url = a.url and p.fetched_at = a.fetched_at and a.rn = 1"""
