"""Every query of the library by name, with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import catalogue as c
from earshot.operators import recommend as r
from earshot.operators import vectors as v
from earshot.plans import described, details, edits, extras, feed, growth, indexes, mixes, models, series, upkeep
from earshot.plans.sql import EVENTS as _E
from earshot.plans.sql import NOW, WHO
from earshot.plans.sql import PART as _PART
from earshot.plans.sql import STATS as _S
from earshot.plans.sql import TRACK_STATS as _TS
from earshot.plans.sql import TRACKS as _T
from earshot.sources.tables import fingerprints, listens, stats, tracks

def _rated(spark, d):
    return r.with_stats(tracks(spark, d), stats(spark, d))


def _hardly(spark, d):
    """Every fifth track as if it was played once at most and never skipped."""
    fifth = F.col("seq") % 5 == 3
    return _rated(spark, d).withColumns({"plays": F.when(fifth, F.col("seq") % 2).otherwise(F.col("plays")), "skips": F.when(fifth, 0).otherwise(F.col("skips"))})


QUERIES: dict = {
    "library_page": lambda s, d: c.page(tracks(s, d), c.TrackFilter(decade=1980), "artist", offset=5, limit=50).select("path", "title", "artist", "year"),
    "library_count": lambda s, d: c.count(tracks(s, d), c.TrackFilter(search="a", decade=1970)),
    "library_albums": lambda s, d: c.albums(tracks(s, d)),
    "library_artists": lambda s, d: c.artists(tracks(s, d), c.TrackFilter(decade=1960)),
    "library_upsert": lambda s, d: c.upsert(tracks(s, d), tracks(s, d).where("year < 1980").withColumn("title", F.concat(F.lit("New "), "title"))).select("path", "title", "seq"),
    "scan_diff": lambda s, d: c.scan_diff(tracks(s, d).where("year > 1955").select("path", F.when(F.col("year") != 1970, F.col("mtime")).alias("mtime")), tracks(s, d).where("year < 1995").select("path", (F.col("mtime") + (F.col("seq") % 4 == 0).cast("int")).alias("mtime"))),
    "folder_totals": lambda s, d: c.folder_totals(tracks(s, d)),
    "listening_stats": lambda s, d: r.listening_stats(tracks(s, d), stats(s, d)),
    "plays_by_artist": lambda s, d: r.plays_by(tracks(s, d), stats(s, d), "artist"),
    "plays_by_album": lambda s, d: r.plays_by(tracks(s, d), stats(s, d), "artist", "album"),
    "artist_affinity": lambda s, d: r.affinity(_rated(s, d), "artist", NOW),
    "genre_affinity": lambda s, d: r.affinity(_rated(s, d), "genre", NOW),
    "rank_diverse": lambda s, d: r.rank_diverse(_rated(s, d).withColumn("score", F.col("plays") * 10 - F.col("skips")), 60, 3).select("seq", "artist", "score"),
    "diversify": lambda s, d: r.diversify(tracks(s, d), 4).select("seq", "artist", "turn", "group_rank"),
    "event_scores": lambda s, d: r.event_scores(listens(s, d), NOW),
    "hourly_clock": lambda s, d: r.hourly_clock(listens(s, d)),
    "hour_preferences": lambda s, d: r.hour_preferences(r.hourly_clock(listens(s, d)), 23),
    **{f"shelf_{k}": (lambda s, d, k=k: r.shelf(_hardly(s, d) if k == "gems" else _rated(s, d), k, NOW).select("seq", "title")) for k in ("liked", "forgotten", "quick", "long", "new", "gems")},
    "smart_playlist": lambda s, d: r.smart_playlist(_rated(s, d), [("title", "contains", "e"), ("rating", "within", 4), ("genre", "is", "nothing")], "any", NOW).select("seq"),
    "vector_moments": lambda s, d: v.moments(fingerprints(s, d)),
    "vector_similar": lambda s, d: v.similar(fingerprints(s, d), 7, 25),
    "vector_described": lambda s, d: v.described(fingerprints(s, d), {3: 1.0, 5: -0.5, 11: 2.0}, 25, 80, 180),
    "vector_centroids": lambda s, d: v.centroids(fingerprints(s, d), "label"),
    "bpm_fold": lambda s, d: fingerprints(s, d).select("id", v.fold_bpm("bpm").alias("bpm")),
}

_SHELVES = {
    "liked": "rating >= 4", "forgotten": f"(rating >= 4 or plays >= 3) and last_played < {NOW - 14 * 86400} and plays > 0", "quick": "duration <= 150", "long": "duration >= 480",
    "new": f"mtime > {NOW - 7 * 86400}", "gems": "case when seq % 5 = 3 then seq % 2 else plays end <= 1 and case when seq % 5 = 3 then 0 else skips end = 0 and rating >= 4"}
_AFF = lambda k, of: f"with {_TS}, a as (select nullif({of}, '') as {k}, {_PART} as c from ts), g as (select {k}, sum(c)::double as s from a where c > 0 and {k} is not null group by {k}) select {k}, s / max(s) over () as affinity from g"

ORACLE: dict[str, str] = {
    "library_page": f"with {_T} select path, title, artist, year from t where year >= 1980 and year < 1990 order by lower(artist) nulls first, lower(title) nulls first, path limit 50 offset 5",
    "library_count": f"with {_T} select count(*) as n from t where lower(title || ' ' || artist || ' ' || album) like '%a%' and year >= 1970 and year < 1980",
    "library_albums": f"with {_T} select coalesce(nullif(album_artist, ''), artist) as artist, album, count(*) as n, min(path) as cover from t group by 1, 2",
    "library_artists": f"with {_T} select coalesce(nullif(album_artist, ''), artist) as artist, count(*) as n from t where year >= 1960 and year < 1970 group by 1",
    "library_upsert": f"with {_T} select path, case when year < 1980 then 'New ' || title else title end as title, seq from t",
    "scan_diff": f"with {_T}, k as (select path, case when year <> 1970 then mtime end as was from t where year > 1955), f as (select path, mtime + case when seq % 4 = 0 then 1 else 0 end as now from t where year < 1995) select coalesce(k.path, f.path) as path, case when f.path is null then 'removed' when was = now then 'unchanged' else 'changed' end as state from k full join f on k.path = f.path",
    "folder_totals": f"with {_T}, p as (select unnest(['/lib', '/lib/' || genre, '/lib/' || genre || '/' || artist]) as folder from t) select folder, count(*) as n from p group by folder",
    "listening_stats": f"with {_T}, {_S} select (select sum(plays)::bigint from s) as total_plays, (select count(*) from s where rating >= 4) as favs, sum(duration * plays)::double as listen_sec, count(*) filter (plays > 0) as played from t join s using (seq)",
    "plays_by_artist": f"with {_T}, {_S} select artist, sum(plays)::bigint as plays from t join s using (seq) group by artist",
    "plays_by_album": f"with {_T}, {_S} select artist, album, sum(plays)::bigint as plays from t join s using (seq) group by artist, album",
    "artist_affinity": _AFF("artist", WHO),
    "genre_affinity": _AFF("genre", "genre"),
    "rank_diverse": f"with {_TS}, x as (select seq, artist, plays * 10 - skips as score from ts), y as (select *, row_number() over (partition by artist order by score desc, seq) as rn from x) select seq, artist, score from y where rn <= 3 order by score desc, seq limit 60",
    "diversify": f"with {_T}, y as (select seq, artist, row_number() over (partition by artist order by seq) as turn, min(seq) over (partition by artist) as group_rank from t) select * from y where turn <= 4",
    "event_scores": f"with {_E} select track, count(*) as events, sum(case kind when 'Like' then 1.5 when 'AddedManually' then 0.8 when 'FullPlay' then 0.5 when 'SkipMid' then -0.5 else -1.0 end::double * pow(0.5::double, ({NOW} - ts) / 86400.0::double / 90)) as score from e where track is not null group by track",
    "hourly_clock": f"with {_E} select (ts // 3600 % 24)::bigint as hour, kind, count(*) as n from e group by 1, 2",
    "hour_preferences": f"with {_E}, h as (select (ts // 3600 % 24)::bigint as hour, kind from e), w as (select kind, sum(case when hour = 23 then 1.0 else 0.5 end)::double as w from h where hour in (22, 23, 0) group by kind) select kind, w / max(w) over () as pref from w",
    **{f"shelf_{k}": f"with {_TS} select seq, title from ts where {w}" for k, w in _SHELVES.items()},
    "smart_playlist": f"with {_TS} select seq from ts where contains(lower(title), 'e') or rating >= 4 or lower(genre) = 'nothing'",
    "vector_moments": "with l as (select unnest(embedding)::double as x, unnest(range(0, len(embedding)))::int as dim from embeddings) select dim, avg(x) as mean, stddev_samp(x) as std from l group by dim",
    "vector_similar": "with q as (select embedding::double[] as q from embeddings where vec_id = 7), x as (select vec_id as id, list_sum(list_transform(range(1, len(q) + 1), lambda i: embedding[i]::double * q[i])) / sqrt(list_sum(list_transform(embedding, lambda a: a::double * a::double)) * list_sum(list_transform(q, lambda a: a * a))) as sim from embeddings, q where vec_id <> 7) select id, sim from x order by sim desc, id limit 25",
    "vector_described": "with x as (select vec_id as id, 60.0 + (vec_id * 7) % 140 as bpm, (embedding[4]::double - 0.5 * embedding[6]::double + 2 * embedding[12]::double) / (sqrt(list_sum(list_transform(embedding, lambda a: a::double * a::double))) * sqrt(5.25::double)) as sim from embeddings) select id, sim from x where sim > 0 and bpm >= 80 and bpm <= 180 order by sim desc, id limit 25",
    "vector_centroids": "with l as (select label, unnest(embedding)::double as x, unnest(range(0, len(embedding)))::int as dim from embeddings), m as (select label, dim, avg(x) as mean from l group by label, dim) select label, dim, mean / sqrt(sum(mean * mean) over (partition by label)) as x from m",
    "bpm_fold": "with b as (select vec_id as id, (60.0 + (vec_id * 7) % 140)::double as b from embeddings) select id, case when b < 70 then b * 2 when b >= 180 then b / 2 else b end as bpm from b",
}

for _more in (feed, series, models, mixes, described, upkeep, edits, details, indexes, growth, extras):
    QUERIES |= _more.QUERIES
    ORACLE |= _more.ORACLE
