"""Queries of files and of curves over time, with their SQL. Orders stand for playlists and users' events for curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import series as ts
from earshot.plans.sql import EVENTS, TRACKS
from earshot.sources import formats as fm
from earshot.sources.tables import listens, read, tracks


def _items(spark, d):
    """Items of orders with a number that is unique within the order."""
    by = ts.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read(spark, d, "lineitem").withColumn("l_linenumber", F.row_number().over(by))


def _entries(spark, d):
    items = _items(spark, d).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("seq"))
    return items.join(tracks(spark, d), "seq").select("id", "pos", "path", "title", "artist", "duration")


def _files(spark, d, line):
    """One text an order, a line an item, made by an expression over lineitem."""
    items = _items(spark, d).select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", line.alias("line")).alias("x"))
    return items.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], "\n").alias("text"))


def _line(kind):
    """A line of a made-up file of that kind, from a row of lineitem."""
    n = F.col("l_linenumber")
    return {
        "lrc": F.when(n % 4 == 0, F.concat(F.lit(" plain "), F.col("l_returnflag"))).otherwise(F.format_string("[%02d:%02d.5][%02d:00]%s", n, F.col("l_quantity").cast("int"), n + 10, F.col("l_linestatus"))),
        "pls": F.concat(F.format_string("File%d=", n), F.when(n % 3 == 0, "file:").otherwise("HTTP://"), F.col("l_partkey").cast("string"), F.when(n % 2 == 0, F.format_string("\nTitle%d= t%d ", n, F.col("l_suppkey"))).otherwise("")),
        "eq": F.when(n == 2, F.format_string("Preamp: -%d dB", F.col("l_quantity").cast("int"))).otherwise(F.format_string("Filter %d: %s pk Fc %d Hz Gain -%d.5 dB Q 1.41", n, F.when(n % 5 == 0, "OFF").otherwise("ON"), F.col("l_partkey"), F.col("l_quantity").cast("int"))),
        "stream": F.concat(F.when(n % 2 == 0, F.format_string("#EXTINF:-1,s%d\n", F.col("l_suppkey"))).otherwise("# note\n"), F.when(n % 3 == 0, "local").otherwise("https://h/"), F.col("l_partkey").cast("string")),
    }[kind]


def _lyrics(s, d):
    return fm.lyric_lines(_files(s, d, _line("lrc")))


def _positions(s, d):
    return _items(s, d).select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 60 + F.col("l_quantity") * 3).cast("double").alias("at")).distinct()


def _points(s, d):
    return ts.numbered(listens(s, d).select(F.col("user_id").alias("id"), "ts", "seq", F.col("value").alias("v")), "ts", "seq")


QUERIES: dict = {
    "playlist_round_trip": lambda s, d: fm.numbered_entries(fm.to_m3u(_entries(s, d))).select("id", F.col("n").alias("pos"), "path", "title", "artist"),
    "playlist_matched": lambda s, d: fm.matched(_entries(s, d).withColumns({"path": F.when(F.col("pos") % 2 == 0, F.concat(F.lit("x/"), "path")).otherwise(F.col("path")), "title": F.when(F.col("pos") % 4 == 0, "").otherwise("given"), "artist": F.lit(None).cast("string")}), tracks(s, d)),
    "playlist_streams": lambda s, d: fm.m3u_streams(_files(s, d, _line("stream"))).select("id", "url", "title"),
    "playlist_numbered": lambda s, d: fm.pls_entries(_files(s, d, _line("pls"))),
    "lyric_lines": lambda s, d: _lyrics(s, d).select("id", "t", "text"),
    "lyric_active": lambda s, d: fm.active_lines(_lyrics(s, d), _positions(s, d)),
    "equalizer_filters": lambda s, d: fm.equalizer_filters(_files(s, d, _line("eq"))).drop("pos"),
    "bucket_means": lambda s, d: ts.bucket_means(_points(s, d), "ts", 7200.0),
    "carried_forward": lambda s, d: ts.carried_forward(_points(s, d).withColumn("v", F.when(F.col("v") > 100, F.col("v")))).select("id", "i", "v"),
    "smoothed": lambda s, d: ts.smoothed(_points(s, d), 3, 3).select("id", "i", "mean"),
    "enhanced_onsets": lambda s, d: ts.enhanced(_points(s, d), 5).select("id", "i", "onset"),
    "curve_peaks": lambda s, d: ts.peaks(_points(s, d)),
    "energy_tiers": lambda s, d: ts.tiers(_points(s, d)).select("id", "i", "level", "tier"),
    "energy_sections": lambda s, d: ts.sections(_points(s, d)),
    "section_at": lambda s, d: ts.containing(ts.sections(_points(s, d)), _points(s, d).select("id", F.col("i").alias("at"))),
    "waveform": lambda s, d: ts.waveform(_points(s, d), 16),
    "listening_sessions": lambda s, d: ts.listening_sessions(listens(s, d).select(F.col("user_id").alias("id"), "seq", "ts", (F.col("track") % 3).alias("track"))),
}

_LI = "li as (select * replace (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::int as l_linenumber) from lineitem)"
_EN = f"{TRACKS}, {_LI}, en as (select l_orderkey as id, l_linenumber as pos, path, title, artist from li join t on seq = l_partkey)"
_LY = f"""{_LI}, ly as (select l_orderkey as id, l_linenumber as pos, unnest(case when l_linenumber % 4 = 0 then [-1.0::double] else [l_linenumber * 60.0::double + l_quantity::int + 0.5::double, (l_linenumber + 10) * 60.0::double] end) as t,
  case when l_linenumber % 4 = 0 then 'plain ' || l_returnflag else l_linestatus end as text from li)"""
_P = f"pt as (select user_id as id, value as v, floor(epoch(ts))::bigint as ts, event_id as seq, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) - 1 as i, count(*) over (partition by user_id) as n from events)"  # noqa: F541
_TIER = f"""{_P}, w as (select *, greatest(2, floor(n * 0.02))::bigint as w from pt), sm as (select a.id, a.i, a.n, avg(b.v) as sm from w a join pt b on a.id = b.id and b.i between a.i - a.w and a.i + a.w group by a.id, a.i, a.n),
  rk as (select *, row_number() over (partition by id order by sm) - 1 as rank from sm),
  lh as (select *, max(case when rank = floor(n * 0.1) then sm end) over (partition by id) as lo, max(case when rank = floor(n * 0.9) then sm end) over (partition by id) as hi from rk),
  lv as (select id, i, n, round(greatest(0, least(1, (sm - lo) / greatest(1e-4, case when hi = 0 then 1 else hi end - lo))), 9) as level from lh),
  tr as (select *, (coalesce(last_value(case when level >= 0.44 then 1 when level < 0.34 then 0 end ignore nulls) over (partition by id order by i), 1) + coalesce(last_value(case when level >= 0.72 then 1 when level < 0.62 then 0 end ignore nulls) over (partition by id order by i), 0))::int as tier from lv)"""
_SEC = f"""{_TIER}, tu as (select *, case when tier <> lag(tier) over (partition by id order by i) then 1 else 0 end as turn from tr), ru as (select *, sum(turn) over (partition by id order by i) as run from tu),
  rn as (select id, run, min(i) as f, max(i) as l, min(tier) as tier, min(n) as n from ru group by id, run),
  kp as (select *, sum(case when run = 0 or l - f + 1 >= greatest(2, floor(n * 0.035)) then 1 else 0 end) over (partition by id order by run) - 1 as section from rn),
  se as (select id, section::bigint as section, min(f) as first, max(l) as last, arg_min(tier, run) as tier from kp group by id, section),
  lb as (select *, case when section = 0 then 'Intro' when section = max(section) over (partition by id) then 'Outro' when tier = 2 then 'Drop' when tier = 0 then 'Break' else 'Verse' end as label from se)"""

ORACLE: dict[str, str] = {
    "playlist_round_trip": f"with {_EN} select id, row_number() over (partition by id order by pos)::int as pos, path, title, artist from en",
    "playlist_matched": f"with {_EN} select id, pos, case when pos % 2 = 0 then 'x/' || path else path end as path, case when pos % 2 = 1 then title when pos % 4 = 0 then regexp_extract(path, '([^/]+)\\.mp3$', 1) else 'given' end as title, case when pos % 2 = 1 then artist else 'Unknown artist' end as artist, pos % 2 = 1 as known from en",
    "playlist_streams": f"""with {_LI}, x as (select l_orderkey as id, l_linenumber as pos, l_partkey as p, case when l_linenumber % 2 = 0 then 's' || l_suppkey end as note, l_linenumber % 3 <> 0 as net from li),
      g as (select *, coalesce(sum(net::int) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0) as grp from x),
      c as (select *, last_value(note ignore nulls) over (partition by id, grp order by pos) as title from g) select id, 'https://h/' || p as url, title from c where net""",
    "playlist_numbered": f"with {_LI} select l_orderkey as id, l_linenumber::bigint as n, 'HTTP://' || l_partkey as url, case when l_linenumber % 2 = 0 then 't' || l_suppkey end as title from li where l_linenumber % 3 <> 0",
    "lyric_lines": f"with {_LY} select id, t, text from ly",
    "lyric_active": f"""with {_LY}, po as (select distinct l_orderkey as id, (l_linenumber * 60 + l_quantity * 3)::double as at_ from li)
      select po.id, po.at_ as "at", arg_max(text, t * 1000 + pos) as text from po left join ly on ly.id = po.id and t >= 0 and t <= at_ + 0.05::double group by po.id, po.at_""",
    "equalizer_filters": f"""with {_LI}, p as (select l_orderkey as id, -max(case when l_linenumber = 2 then l_quantity::int end)::double as pre from li group by 1)
      select l_orderkey as id, coalesce(pre, 0.0) as preamp, 'PK' as kind, l_partkey::double as fc, -(l_quantity::int + 0.5)::double as gain, 1.41::double as q from li join p on id = l_orderkey where l_linenumber <> 2 and l_linenumber % 5 <> 0""",
    "bucket_means": f"with {_P} select id, (ts // 7200)::bigint as bucket, avg(v) as mean, count(*) as n from pt where v > 0.001 group by 1, 2",
    "carried_forward": f"with {_P} select id, i::int as i, last_value(case when v > 100 then v end ignore nulls) over (partition by id order by i) as v from pt",
    "smoothed": f"with {_P} select id, i::int as i, avg(v) over (partition by id order by i rows between 3 preceding and 3 following) as mean from pt",
    "enhanced_onsets": f"with {_P}, r as (select id, i, greatest(0, v - avg(v) over (partition by id order by i rows between 4 preceding and current row)) as rise from pt) select id, i::int as i, case when stddev_pop(rise) over (partition by id) > 1e-9 then rise / stddev_pop(rise) over (partition by id) else rise end as onset from r",
    "curve_peaks": f"with {_P}, q as (select *, lag(v) over (partition by id order by i) as was, lead(v) over (partition by id order by i) as nxt, avg(v) over (partition by id) + stddev_pop(v) over (partition by id) as level from pt), k as (select * from q where v > was and v >= nxt and v > level) select id, i::int as i, v, (i - lag(i) over (partition by id order by i))::int as gap from k",
    "energy_tiers": f"with {_TIER} select id, i::int as i, level, tier from tr",
    "energy_sections": f"with {_SEC} select * from lb",
    "section_at": f"with {_SEC} select pt.id, pt.i as \"at\", label from pt left join lb on lb.id = pt.id and pt.i between first and last",
    "waveform": f"with {_P}, b as (select id, i // greatest(1, n // 16) as bucket, max(abs(v)) as peak from pt where i // greatest(1, n // 16) < 16 group by 1, 2) select id, bucket, case when max(peak) over (partition by id) > 0 then peak / max(peak) over (partition by id) else 0 end as peak from b",
    "listening_sessions": f"""with x as (select user_id as id, event_id as seq, floor(epoch(ts))::bigint as ts, json_extract_string(props, '$.k')::bigint % 3 as track from events),
      g as (select *, case when row_number() over (partition by id order by seq) > 1 and lag(track) over (partition by id order by seq) is not distinct from track then 0 else 1 end as turn from x),
      r as (select *, sum(turn) over (partition by id order by seq) - 1 as session from g) select id, session::bigint as session, any_value(track) as track, min(ts) as start, max(ts) as finish, count(*) as events from r group by 1, 2""",  # noqa: F541
}
