"""Queries of the feed, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import text as x
from earshot.operators import feed as f
from earshot.operators import recommend as r
from earshot.plans.sql import BASE, NOW, PART, TRACK_STATS as TS, WHO
from earshot.sources.tables import stats, tracks

LATER = NOW + 360 * 86_400
WEEK = 202_405


def _rated(spark, d):
    return r.with_stats(tracks(spark, d), stats(spark, d))


def _hardly(spark, d):
    """Every fifth track as if it was played once at most and never skipped."""
    fifth = F.col("seq") % 5 == 3
    return _rated(spark, d).withColumns({"plays": F.when(fifth, F.col("seq") % 2).otherwise(F.col("plays")), "skips": F.when(fifth, 0).otherwise(F.col("skips"))})


QUERIES: dict = {
    "blend_scores": lambda s, d: f.blend_scores(_rated(s, d), NOW).select("seq", "score"),
    **{f"smart_blend_{k}": (lambda s, d, k=k: f.smart_blend(_rated(s, d), NOW, 50, k).select("seq", "who", "score")) for k in f.EXPLORE},
    "hidden_gems": lambda s, d: f.hidden_gems(_hardly(s, d), NOW).select("seq", "title"),
    "because_played": lambda s, d: f.because_played(_rated(s, d), NOW).select("seed", "seq", "score"),
    "discover_weekly": lambda s, d: f.discover_weekly(_rated(s, d).withColumn("plays", F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("plays"))), WEEK).select("seq", "turn"),
    "release_radar": lambda s, d: f.release_radar(_rated(s, d), NOW).select("seq", "turn"),
    "throwback": lambda s, d: f.throwback(_rated(s, d), LATER).select("seq", "turn"),
    "rediscover": lambda s, d: f.rediscover(_rated(s, d), LATER).select("seq", "turn"),
    "mood_lane": lambda s, d: f.mood_lane(_rated(s, d).withColumn("genre", F.concat("genre", F.lit(" Rock"))), "energy").select("seq", "turn"),
    "genre_groups": lambda s, d: f.genre_groups(tracks(s, d)),
    "decade_groups": lambda s, d: f.decade_groups(tracks(s, d)),
    "artist_groups": lambda s, d: f.artist_groups(_rated(s, d)),
    "album_groups": lambda s, d: f.album_groups(_rated(s, d), 1),
    "year_in_review": lambda s, d: f.year_in_review(_rated(s, d)),
    "deep_cuts": lambda s, d: f.deep_cuts(_rated(s, d).withColumn("plays", F.when(F.col("seq") % 4 == 0, 0).otherwise(F.col("plays")))).select("seq"),
    "quick_picks": lambda s, d: f.quick_picks(_rated(s, d)),
    "fresh_familiar": lambda s, d: f.fresh_familiar(_rated(s, d)),
    "track_labels": lambda s, d: _rated(s, d).select(
        "seq", x.file_name("path").alias("file"), x.stem("path").alias("stem"), x.folder("path").alias("folder"), x.is_audio("path").alias("audio"), x.initial("title").alias("letter"),
        x.clock(F.col("duration") * 9).alias("clock"), x.span(F.col("duration") * F.col("plays")).alias("span"), x.ago("last_played", NOW).alias("ago"),
        x.slot(F.col("seq") % 24).alias("slot"), x.fnv1a("path").alias("fnv"), x.is_missing(F.when(F.col("seq") % 4 == 0, "Unknown Artist").otherwise(F.col("artist"))).alias("missing")),
    "playback_kinds": lambda s, d: tracks(s, d).select("seq", x.playback_kind((F.col("seq") * 7 % 400).cast("double"), F.when(F.col("seq") % 10 == 0, 0.0).otherwise(F.col("duration")), F.col("seq") % 13 == 0).alias("kind")),
    "byte_ranges": lambda s, d: tracks(s, d).select("seq", x.byte_range(F.when(F.col("seq") % 3 == 0, F.format_string("bytes=-%d", F.col("seq"))).when(F.col("seq") % 3 == 1, F.format_string("bytes=%d-", F.col("seq"))).otherwise(F.format_string("bytes=%d-%d", F.col("seq"), F.col("seq") + 500)), F.lit(1000)).alias("r")).select("seq", "r.start", "r.end"),
    "date_keys": lambda s, d: tracks(s, d).select("seq", x.day_key(F.timestamp_seconds("mtime")).alias("day"), x.week_key(F.timestamp_seconds("mtime")).alias("week")),
}

_AFF = f"""aff as (select who, sum(c)::double as s from (select {WHO} as who, {PART} as c from ts) where c > 0 and who <> '' group by who), an as (select who, s / max(s) over () as a from aff),
  gen as (select genre, sum(c)::double as s from (select genre, {PART} as c from ts) where c > 0 and genre <> '' group by genre), gn as (select genre, s / max(s) over () as g from gen)"""
_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(path, ''), lambda c: ascii(c)::bigint)), lambda h, c: ((xor(h, c) * 16777619::bigint) & 4294967295::bigint))"


def _scores(explore: float) -> str:
    return f"""{_AFF}, b as (select ts.*, {WHO} as who, {BASE} as base from ts), m as (select *, greatest(0, max(base) over ()) as top from b),
  j as (select m.*, coalesce(a, 0) as a, coalesce(g, 0) as g, abs((last_played // 3600 % 24) - ({NOW} // 3600 % 24)) % 24 as d0 from m left join an using (who) left join gn using (genre)),
  k as (select *, least(d0, 24 - d0) as apart from j),
  sc as (select *, 0.45::double * a + 0.30::double * g + 0.15::double * case when top > 0 then greatest(0, base) / top else 0 end
    + case when plays = 0 and a > 0.15::double then 0.20::double * {explore} else 0 end - case when skips >= 2 and rating < 4 then 0.30::double else 0 end
    - case when last_played > 0 and {NOW} - last_played < 172800 then 0.50::double * {max(1.0, explore)} else 0 end
    + case when last_played > 0 and apart <= 3 then 0.08::double * (1 - apart / 3.0::double) else 0 end + 0.06::double * (({_FNV}) % 1000 / 1000.0::double) as score from k)"""


def _diverse(n: int, per: int, of: str) -> str:
    return f"(select * from (select *, row_number() over (partition by who order by score desc, seq) as rn from {of}) where rn <= {per} order by score desc, seq limit {n})"


def _sample(pool: str, n: int, seed: int, least: int) -> str:
    return f"""pool as ({pool}), pk as (select *, md5('{seed}:' || path) as key, lower(coalesce(nullif({WHO}, ''), '?')) as w from pool where (select count(*) from pool) >= {least}),
  pt as (select *, row_number() over (partition by w order by key, seq) as turn from pk), pg as (select *, min(key) over (partition by w) as gk from pt where turn <= {max(2, -(-n // 6))})
  select seq, turn from pg order by turn, gk limit {n}"""


_TSZ = f"{TS.rsplit(', ts as', 1)[0]}, ts0 as {TS.rsplit('ts as ', 1)[1]}, ts as (select * replace (case when seq % 3 = 0 then 0 else plays end as plays) from ts0)"
_TSH = f"{TS.rsplit(', ts as', 1)[0]}, ts0 as {TS.rsplit('ts as ', 1)[1]}, ts as (select * replace (case when seq % 5 = 3 then seq % 2 else plays end as plays, case when seq % 5 = 3 then 0 else skips end as skips) from ts0)"
_LISTS = """liked as (select seq, row_number() over (order by seq) - 1 as pos from ts where rating >= 4 order by seq limit 60),
  played as (select seq, row_number() over (order by plays desc, seq) - 1 as pos from ts where plays > 0 order by plays desc, seq limit 60),
  added as (select seq, row_number() over (order by coalesce(mtime, 0) desc, seq) - 1 as pos from ts order by coalesce(mtime, 0) desc, seq limit 60)"""

ORACLE: dict[str, str] = {
    "blend_scores": f"with {TS}, {_scores(1.0)} select seq, score from sc",
    **{f"smart_blend_{k}": f"with {TS}, {_scores(e)}, c as (select * from sc where score > 0.08::double), top as {_diverse(50, 3, 'c')} select seq, who, score from top" for k, e in f.EXPLORE.items()},
    "hidden_gems": f"with {_TSH}, {_AFF} select seq, title from (select ts.*, {WHO} as who from ts) t left join an using (who) where plays <= 1 and skips = 0 and (rating >= 4 or a > 0.4::double) order by seq limit 40",
    "because_played": f"""with {TS}, {_scores(1.0)}, sd as (select who as seed from an order by a desc, who limit 1),
      sg as (select genre from ts, sd where {WHO} = seed and genre <> '' group by genre order by count(*) desc, min(seq) limit 1),
      c as (select seed, seq, who, score + case when who = seed then 0.15::double else 0 end as score from sc, sd where who = seed or genre = (select genre from sg)),
      tp as {_diverse(30, 6, 'c')} select seed, seq, score from tp where (select count(*) from tp) >= 4""",
    "discover_weekly": f"with {_TSZ}, " + _sample("select * from ts where plays = 0 and rating not in (1, 2)", 30, WEEK, 6),
    "release_radar": f"""with {TS}, own as (select distinct lower(trim({WHO})) as o from ts where plays > 0), rec as (select *, lower(trim({WHO})) in (select o from own where o <> '') as yours from ts where mtime > 0 and {NOW} - mtime <= 45 * 86400),
      """ + _sample("select * from rec where yours or (select count(*) from rec where yours) < 4", 18, 555, 4),
    "throwback": f"with {TS}, " + _sample(f"select * from ts where mtime > 0 and {LATER} - mtime between 330 * 86400 and 400 * 86400", 18, 9001, 4),
    "rediscover": f"with {TS}, " + _sample(f"select * from ts where rating >= 4 and (last_played = 0 or {LATER} - last_played > 120 * 86400)", 18, 4242, 4),
    "mood_lane": f"with {TS}, " + _sample("select * from ts", 18, 6 * 97 + 13, 4),
    "genre_groups": f"with {TS} select trim(genre) as genre, count(*) as n from ts where trim(genre) <> '' group by 1 having count(*) >= 5 order by n desc, genre limit 12",
    "decade_groups": f"with {TS} select (year // 10 * 10)::bigint as decade, count(*) as n from ts group by 1 having count(*) >= 8",
    "artist_groups": f"with {TS} select {WHO} as artist, count(*) as n, sum(plays)::bigint as plays from ts group by 1 having sum(plays) > 0 order by plays desc, 1 limit 12",
    "album_groups": f"with {TS} select {WHO} as artist, album, count(*) as n, sum(plays)::bigint as plays, arg_min(path, seq) as cover from ts group by {WHO}, album order by sum(plays) desc, arg_min(mtime, seq) desc, 1, album limit 20",
    "year_in_review": f"with {TS} select round(sum(duration * plays) / 60)::bigint as minutes, count(*) as played from ts where plays > 0 having count(*) >= 8",
    "deep_cuts": f"with {_TSZ.replace('seq % 3 = 0', 'seq % 4 = 0')} select seq from ts where plays = 0 and {WHO} in (select {WHO} from ts where plays > 0)",
    "quick_picks": f"with {TS}, {_LISTS} select seq, min(place)::bigint as place from (select seq, pos as place from liked union all select seq, 100 + pos from played union all select seq, 200 + pos from added) group by seq order by 2 limit 27",
    "fresh_familiar": f"""with {TS}, {_LISTS}, fav as (select seq, row_number() over (order by p) - 1 as pos from (select seq, pos as p from liked union all select seq, 100 + pos from played))
      select seq, min(place)::bigint as place from (select seq, 2 * pos as place from added where pos < 24 union all select seq, 2 * pos + 1 from fav where pos < 24) group by seq order by 2 limit 40""",
    "track_labels": f"""with {TS}, q as (select *, floor(duration * 9)::bigint as ck, floor(duration * plays + 0.5)::bigint as sp, {NOW} - last_played as ag from ts) select seq, split_part(path, '/', 5) as file, regexp_replace(split_part(path, '/', 5), '\\.[^.]+$', '') as stem, regexp_replace(path, '/[^/]*$', '') as folder, true as audio,
      case when regexp_matches(upper(left(title, 1)), '^[A-Z]$') then upper(left(title, 1)) else '#' end as letter,
      case when ck >= 3600 then format('{{}}:{{:02d}}:{{:02d}}', ck // 3600, ck // 60 % 60, ck % 60) else format('{{}}:{{:02d}}', ck // 60, ck % 60) end as clock,
      case when sp >= 3600 then format('{{}}h {{}}m', sp // 3600, sp // 60 % 60) when sp >= 60 then format('{{}}m', sp // 60) else format('{{}}s', sp) end as span,
      case when ag < 60 then 'just now' when ag < 3600 then (ag // 60) || 'm ago' when ag < 86400 then (ag // 3600) || 'h ago' else (ag // 86400) || 'd ago' end as ago,
      case when seq % 24 < 5 or seq % 24 >= 22 then 'night' when seq % 24 < 12 then 'morning' when seq % 24 < 17 then 'afternoon' else 'evening' end as slot, {_FNV} as fnv, seq % 4 = 0 as missing from q""",
    "playback_kinds": f"""with {TS}, q as (select seq, (seq * 7 % 400)::double as p, case when seq % 10 = 0 then 0 else duration end as d, seq % 13 = 0 as e from ts)
      select seq, case when e then 'FullPlay' when d <= 0 then case when p >= 30 then 'FullPlay' else 'SkipMid' end when p / d >= 0.9::double then 'FullPlay' when p < 15 then 'SkipEarly' when p / d < 0.5::double then 'SkipMid' else 'SkipLate' end as kind from q""",
    "byte_ranges": f"""with {TS}, q as (select seq, case seq % 3 when 0 then greatest(0, 1000 - seq) else seq end as a, case seq % 3 when 2 then least(999, seq + 500) else 999 end as b from ts)
      select seq, (case when a <= b and a < 1000 then a end)::bigint as start, (case when a <= b and a < 1000 then b end)::bigint as end from q""",
    "date_keys": f"with {TS}, q as (select seq, make_timestamp((mtime * 1000000)::bigint) as t from ts) select seq, strftime(t, '%Y%m%d')::bigint as day, (isoyear(t) * 100 + weekofyear(t))::bigint as week from q",
}
