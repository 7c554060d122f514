"""Queries of lookups, small derivations, colours and measures of sound, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import colour
from earshot.functions import text as x
from earshot.operators import lookups as k
from earshot.operators import recommend as r
from earshot.operators import series as se
from earshot.operators import sound as so
from earshot.plans.models import _FP
from earshot.plans.sql import NOW, TRACK_STATS, TRACKS
from earshot.sources.tables import fingerprints, read, stats, tracks


def _rated(s, d):
    return r.with_stats(tracks(s, d), stats(s, d))


def _blank(s, d):
    """Tracks some of whose names are missing."""
    n = F.col("seq")
    return tracks(s, d).withColumns({
        "title": F.when(n % 5 == 0, "").otherwise(F.col("title")), "artist": F.when(n % 4 == 0, "").when(n % 7 == 0, F.lit(None)).otherwise(F.col("artist")), "album": F.when(n % 6 == 0, F.lit(None)).when(n % 9 == 0, "Folder").otherwise(F.col("album"))})


def _found(s, d):
    n = F.col("seq")
    return tracks(s, d).where("seq % 3 <> 1").select("path", F.when(n % 2 == 0, F.concat(F.lit(" "), "title", F.lit(" "))).otherwise(" ").alias("title"), F.when(n % 5 == 0, "Found").alias("artist"), F.when(n % 11 == 0, "Band").alias("album_artist"), F.when(n % 10 == 0, "Record").alias("album"), F.lit(None).cast("string").alias("genre"), F.when(n % 8 == 0, "1999-05").when(n % 8 == 1, "x").alias("year"), F.when(n % 7 == 0, 99.5).otherwise(0.0).alias("duration"))


def _played(s, d):
    """Lines of orders as a queue, with their tracks' albums."""
    q = read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("n"))
    return q.select("id", (F.col("pos") * 10_000_000 + F.col("n")).alias("pos"), F.concat(F.lit("Album "), (F.col("n") % 3).cast("string")).alias("album"), F.when(F.col("n") % 2 == 0, "A").alias("album_artist"), F.lit("a").alias("artist"))


def _ratings(s, d):
    return read(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("track"), (F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("seq"), (F.col("l_partkey") % 6).alias("rating"))


def _pixels(s, d):
    return read(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("id"), (F.col("l_partkey") * 7 % 256).cast("int").alias("r"), (F.col("l_suppkey") * 13 % 256).cast("int").alias("g"), (F.col("l_orderkey") * 3 % 256).cast("int").alias("b"), F.when(F.col("l_linenumber") == 7, 0).otherwise(255).alias("a"))


def _curve(s, d):
    e = read(s, d, "events").select(F.col("user_id").alias("id"), "event_id", F.col("value").alias("v"))
    return se.numbered(e, "event_id")


def _hits(s, d):
    fp = fingerprints(s, d).select("id", F.col("bpm").cast("double").alias("bpm"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"))
    return fp.select("id", (F.col("bpm") + 1).alias("bpm"), (F.col("k") * 60.0 / F.col("bpm") + (F.col("id") * F.col("k") % 7 - 3) * 0.0003).alias("t"))


def _raw(s, d):
    """Vectors at the scale of raw features."""
    v = F.transform("v", lambda z, i: F.abs(z.cast("double")) * F.when(i == 26, 9000.0).when(i == 28, 18_000.0).when(i == 39, 20.0).when(i == 42, 60.0).when(i == 43, 6.0).otherwise(3.0))
    return fingerprints(s, d).select("id", v.alias("v"), F.col("bpm").cast("double").alias("bpm"), (F.col("id") % 10 / 10.0).alias("tempo_conf"))


def _levels(s, d):
    return fingerprints(s, d).select("id", F.transform(F.slice("v", 1, 10), lambda z: z.cast("double") * 20).alias("levels"))


def _folders(s, d):
    return k.folder_list(tracks(s, d).where("seq % 3 = 0"))


def _cache(s, d):
    return tracks(s, d).where("seq % 2 = 0").select("path", F.when(F.col("seq") % 10 == 0, 0.0).otherwise(F.col("mtime")).alias("mtime"), (F.col("seq") % 8).alias("version"))


def _names(s, *rows):
    return s.createDataFrame(list(rows), "name string, value long, seen long")


QUERIES: dict = {
    "tracks_shown": lambda s, d: k.shown(_blank(s, d)).select("seq", "title", "artist", "album"),
    "ranked_resolved": lambda s, d: k.resolved(tracks(s, d).select((F.col("seq") * 2).alias("seq"), F.col("seq").alias("rank")), tracks(s, d)).select("seq", "rank", "title"),
    "gapless_joins": lambda s, d: k.gapless(_played(s, d)).select("id", "pos", "joined"),
    "rating_events": lambda s, d: k.rating_events(_ratings(s, d)),
    "abandoned_plays": lambda s, d: tracks(s, d).select("seq", k.abandoned((F.col("seq") * 7 % 400).cast("double"), "duration", F.col("seq") % 13 == 0).alias("left"), k.needs_enrichment(F.when(F.col("seq") % 9 == 0, "Folder").otherwise(F.col("album")), "artist").alias("needs")),
    "tracks_enriched": lambda s, d: k.enriched(_blank(s, d), _found(s, d)).select("seq", "title", "artist", "album_artist", "album", "genre", "year", "duration"),
    "cache_hits": lambda s, d: k.cache_hits(tracks(s, d).select("path", "mtime"), _cache(s, d)),
    "cache_found": lambda s, d: k.cached_for(tracks(s, d).where("year > 1970"), _cache(s, d)),
    "cache_merged": lambda s, d: k.merged_cache(tracks(s, d).select("path", "title", "artist"), tracks(s, d).where("seq % 3 = 0").select("path", F.lit("Cached").alias("title"), F.when(F.col("seq") % 2 == 0, "Unknown Artist").otherwise("Someone").alias("artist"))),
    "song_curves": lambda s, d: k.song_curves(tracks(s, d), tracks(s, d).where("seq % 5 = 0").select("seq", F.lit("pinned").alias("curve")), tracks(s, d).where("seq % 3 = 0").select("seq", F.lit("found").alias("curve")), "flat"),
    "device_curves": lambda s, d: k.device_curves(read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("address"), F.concat(F.lit("p"), (F.col("s_suppkey") % 6).cast("string")).alias("preset")), read(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("address"), F.col("s_name").alias("name")), s.createDataFrame([("p1", "own"), ("p2", "own")], "preset string, curve string"), s.createDataFrame([("p2", "built"), ("p3", "built")], "preset string, curve string")),
    "devices_remembered": lambda s, d: k.remembered_devices(read(s, d, "nation").select((F.col("n_nationkey") % 20).cast("string").alias("address"), F.col("n_name").alias("name")).dropDuplicates(["address"]).select("address", F.lit("old").alias("name")), read(s, d, "nation").select((F.col("n_nationkey") % 7 + 15).cast("string").alias("address"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("name"), F.col("n_nationkey").alias("seq"))),
    "lyrics_beside": lambda s, d: k.first_sidecar(tracks(s, d).select("path"), tracks(s, d).select(F.explode(F.array(F.struct(F.concat(F.substring_index("path", ".", 1), F.lit(".txt")).alias("file"), F.col("title").alias("content")), F.struct(F.concat(F.substring_index("path", ".", 1), F.lit(".lrc")).alias("file"), F.when(F.col("seq") % 2 == 0, "  ").otherwise("[00:01]x").alias("content")))).alias("e")).select("e.*"), ["lrc", "txt"]),
    "folder_covers": lambda s, d: k.folder_covers(tracks(s, d).select(F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"), F.when(F.col("seq") % 4 == 0, "FRONT.png").when(F.col("seq") % 4 == 1, "Cover.jpg").when(F.col("seq") % 4 == 2, "folder.webp").otherwise("notes.txt")).alias("file"))),
    "folder_list": lambda s, d: _folders(s, d),
    "folders_covering": lambda s, d: k.covering(_folders(s, d).select("folder").union(tracks(s, d).where("seq % 4 = 0").select(F.concat(F.lit("/lib/"), "genre"))).distinct(), _folders(s, d)),
    "folders_collapsed": lambda s, d: k.collapsed(_folders(s, d)),
    "texts_translated": lambda s, d: k.translated(tracks(s, d).select("seq", F.concat(F.lit("k"), (F.col("seq") % 4).cast("string")).alias("key"), F.create_map(F.lit("n"), F.col("seq").cast("string")).alias("vars")), s.createDataFrame([("de", "k1", "{n} Lieder"), ("en", "k1", "{n} songs"), ("en", "k2", "all {n} of {n}")], "lang string, key string, text string"), "de").select("seq", "text"),
    "browse_lists": lambda s, d: k.browse_lists(_rated(s, d), read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("seq"))),
    "year_songs": lambda s, d: k.year_review(_rated(s, d)),
    "recent_history": lambda s, d: k.recent_history(_rated(s, d)),
    "scroll_labels": lambda s, d: _rated(s, d).select("seq", *[k.scroll_label(n).alias(n) for n in ("title", "artist", "album", "year", "duration", "rating", "plays", "recent")]),
    "text_derivations": lambda s, d: tracks(s, d).select(
        "seq", x.content_type(F.when(F.col("seq") % 3 == 0, "MP3").when(F.col("seq") % 3 == 1, "flac").otherwise("xyz")).alias("mime"), x.capitalised("title").alias("capital"), x.token("path").alias("token"), x.lyrics_url("genius", "artist", "title").alias("lyrics"),
        x.tree_path(F.concat(F.lit("content://a/tree/"), F.when(F.col("seq") % 2 == 0, "primary%3AMusic%2F").otherwise("card%3A"), F.col("seq").cast("string"))).alias("tree"), x.joined_url(F.lit("http://h:1/a/b"), F.when(F.col("seq") % 3 == 0, "/x").when(F.col("seq") % 3 == 1, "y").otherwise("http://z/")).alias("url"), x.escaped_xml(F.concat(F.lit('<a b="c">&'), "artist")).alias("xml")),
    "page_hosts": lambda s, d: read(s, d, "pages").select("page_id", x.url_host("url").alias("host"), x.tag_text("html", "h1").alias("head")),
    "colours": lambda s, d: _pixels(s, d).select("r", "g", "b").distinct().withColumn("x", colour.hsl("r", "g", "b")).select("r", "g", "b", "x.h", "x.s", "x.l"),
    "colours_back": lambda s, d: _pixels(s, d).select("r", "g", "b").distinct().withColumn("x", colour.hsl("r", "g", "b")).select("r", "g", "b", colour.rgb_of(colour.hex_of("x.h", "x.s", "x.l")).alias("y")).select("r", "g", "b", F.col("y.r").alias("r2"), F.col("y.g").alias("g2"), F.col("y.b").alias("b2")),
    "vivid_hues": lambda s, d: colour.vivid_hues(_pixels(s, d)),
    "luminance": lambda s, d: colour.luminance(_pixels(s, d)),
    "crest_factors": lambda s, d: so.crest(_curve(s, d)),
    "chroma_entropies": lambda s, d: fingerprints(s, d).select("id", so.chroma_entropy(F.transform(F.slice("v", 1, 12), lambda z: F.abs(z.cast("double")))).alias("entropy")),
    "envelopes": lambda s, d: so.envelope(_curve(s, d), 10),
    "onset_density": lambda s, d: so.onset_density(_curve(s, d), 43.0),
    "transients": lambda s, d: so.transients(_curve(s, d), 4, 3),
    "voted_tempos": lambda s, d: so.voted_tempo(_hits(s, d)),
    "genre_features": lambda s, d: so.genre_features(_raw(s, d)).withColumn("tags", F.array_join(so.sound_tags(F.col("id") % 5 == 0), ",")),
    "corrective_curves": lambda s, d: _levels(s, d).select("id", so.corrective_curve("levels").alias("x")).select("id", F.posexplode("x.gains").alias("band", "gain"), "x.preamp"),
    "curve_response": lambda s, d: _levels(s, d).select("id", so.curve_response(F.log10(F.lit(1000.0)), "levels", F.array(*[F.lit(31.25 * 2**i) for i in range(10)]), F.array(*[F.lit(0.1 + 0.2 * i) for i in range(10)]), F.lit(-1.5)).alias("db")),
    "centroids_merged": lambda s, d: so.merged_centroids(fingerprints(s, d).select(F.col("label").alias("g"), F.transform("v", lambda z: z.cast("double")).alias("v"), F.col("bpm").cast("double").alias("bpm"), (1.0 + F.col("id") % 5).alias("mass")), "g").select("g", "mass", "bpm", F.posexplode("v").alias("dim", "x")),
    "taste_counts": lambda s, d: fingerprints(s, d).agg(F.count(F.lit(1)).alias("tracks"), F.count_distinct("label").alias("clusters")).join(read(s, d, "events").agg(F.count(F.lit(1)).alias("events")), F.lit(True)),
}

_B = f"""{TRACKS}, bl as (select * replace (case when seq % 5 = 0 then '' else title end as title, case when seq % 4 = 0 then '' when seq % 7 = 0 then null else artist end as artist, case when seq % 6 = 0 then null when seq % 9 = 0 then 'Folder' else album end as album) from t)"""
_PX = "px as (select l_orderkey % 50 as id, (l_partkey * 7 % 256)::int as r, (l_suppkey * 13 % 256)::int as g, (l_orderkey * 3 % 256)::int as b, case when l_linenumber = 7 then 0 else 255 end as a from lineitem)"
_HSL = """c1 as (select *, r / 255.0::double as x, g / 255.0::double as y, b / 255.0::double as z from px), c2 as (select *, greatest(x, y, z) as hi, least(x, y, z) as lo from c1), c3 as (select *, hi - lo as d, (hi + lo) / 2 as li from c2),
  c4 as (select *, case when d = 0 then 0 when li > 0.5::double then d / (2 - hi - lo) else d / (hi + lo) end * 100 as s, li * 100 as l, case when d = 0 then 0 when hi = x then (y - z) / d + case when y < z then 6 else 0 end when hi = y then (z - x) / d + 2 else (x - y) / d + 4 end * 60 as h from c3)"""
_CU = "cu as (select user_id as id, value as v, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events)"
_FO = f"{TRACKS}, fo as (select regexp_replace(path, '/[^/]*$', '') as folder, count(*) as n from t where seq % 3 = 0 group by 1)"
_L = "lv as (select vec_id as id, list_transform(embedding[1:10], lambda z: z::double * 20) as lv from embeddings)"
_LETTER = lambda c: f"case when regexp_matches(upper(left(trim({c}), 1)), '^[A-Z]$') then upper(left(trim({c}), 1)) else '#' end"
_HOUSE = [v - sum(so.HOUSE) / len(so.HOUSE) for v in so.HOUSE]
_UNIT = lambda e: f"greatest(0, least(1, {e}))"
_RAW = "rw as (select vec_id as id, list_transform(embedding, lambda z, i: abs(z::double) * case i when 27 then 9000.0 when 29 then 18000.0 when 40 then 20.0 when 43 then 60.0 when 44 then 6.0 else 3.0 end::double) as v, (60.0 + (vec_id * 7) % 140)::double as bpm, vec_id % 10 / 10.0::double as tc from embeddings)"

ORACLE: dict[str, str] = {
    "tracks_shown": f"with {_B} select seq, coalesce(nullif(title, ''), seq::varchar) as title, coalesce(nullif(artist, ''), nullif(album_artist, ''), 'Unknown artist') as artist, coalesce(nullif(album, ''), 'Unknown album') as album from bl",
    "ranked_resolved": f"with {TRACKS} select t.seq, q.seq as rank, title from (select seq from t) q join t on t.seq = q.seq * 2",
    "gapless_joins": """with q as (select l_orderkey as id, l_linenumber * 10000000::bigint + l_partkey as pos, l_partkey % 3 as al from lineitem) select id, pos, coalesce(al = lag(al) over (partition by id order by pos), false) as joined from q""",
    "rating_events": """with q as (select l_suppkey % 50 as track, l_orderkey * 100000000::bigint + l_linenumber * 10000000::bigint + l_partkey as seq, l_partkey % 6 as rating from lineitem), o as (select *, coalesce(lag(rating) over (partition by track order by seq), 0) as was from q)
      select track, seq, rating, case when rating >= 4 then 'Like' else 'Dislike' end as kind from o where rating <> was and (rating >= 4 or rating in (1, 2))""",
    "abandoned_plays": f"with {TRACKS} select seq, seq % 13 <> 0 and duration > 30 and (seq * 7 % 400) / duration < 0.2::double as left, seq % 9 = 0 as needs from t",
    "tracks_enriched": f"""with {_B}, m as (select *, seq % 3 <> 1 as f from bl) select seq, case when f and seq % 2 = 0 then (select any_value(p_name) from part where p_partkey = seq) else title end as title,
      case when f and seq % 5 = 0 then 'Found' when f and seq % 11 = 0 then 'Band' else artist end as artist, case when f and seq % 11 = 0 then 'Band' else album_artist end as album_artist,
      case when f and seq % 10 = 0 then 'Record' when f and album = 'Folder' then 'Unknown album' else album end as album, genre, (case when f and seq % 8 = 0 then 1999 else year end)::bigint as year, case when f and seq % 7 = 0 then 99.5::double else duration end as duration from m""",
    "cache_hits": f"with {TRACKS} select path, mtime, seq % 2 = 0 and seq % 10 <> 0 and seq % 8 >= 5 as hit from t",
    "cache_found": f"with {TRACKS} select count(*) filter (seq % 2 = 0) as found, count(*) filter (seq % 2 <> 0) as skipped from t where year > 1970",
    "cache_merged": f"with {TRACKS} select path, case when seq % 6 = 3 then 'Cached' else title end as title, case when seq % 6 = 3 then 'Someone' else artist end as artist from t",
    "song_curves": f"with {TRACKS} select seq, case when seq % 5 = 0 then 'pinned' when seq % 3 = 0 then 'found' else 'flat' end as curve, case when seq % 5 = 0 then 'pin' when seq % 3 = 0 then 'auto' else 'base' end as source from t",
    "device_curves": "select s_suppkey::varchar as address, case when s_suppkey % 2 = 0 then s_name else s_suppkey::varchar end as device, 'p' || s_suppkey % 6 as preset, case when s_suppkey % 6 in (1, 2) then 'own' else 'built' end as curve from supplier where s_suppkey % 6 in (1, 2, 3)",
    "devices_remembered": "with k as (select distinct (n_nationkey % 20)::varchar as address from nation), s as (select (n_nationkey % 7 + 15)::varchar as address, arg_max(n_name, n_nationkey) filter (n_nationkey % 3 <> 0) as new from nation group by 1) select coalesce(k.address, s.address) as address, coalesce(new, case when k.address is not null then 'old' end, '') as name from k full join s on k.address = s.address",
    "lyrics_beside": f"with {TRACKS} select path, case when seq % 2 = 0 then title else '[00:01]x' end as content from t",
    "folder_covers": f"""with {TRACKS}, i as (select regexp_replace(path, '/[^/]*$', '') as folder, (seq % 4)::int as m from t where seq % 4 <> 3), b as (select folder, min(case m when 2 then 1 when 0 then 2 else 3 end) as k from i group by folder)
      select folder, folder || '/' || ['folder.webp', 'FRONT.png', 'Cover.jpg'][k] as cover from b""",
    "folder_list": f"with {_FO} select folder, n from fo",
    "folders_covering": f"with {_FO}, ck as (select folder from fo union select '/lib/' || genre from t where seq % 4 = 0) select folder, coalesce(n, 0) as n from ck left join fo using (folder) where not exists (select 1 from ck o where starts_with(ck.folder, o.folder || '/'))",
    "folders_collapsed": f"""with {_FO}, p as (select folder, n, string_split(folder, '/') as ps from fo), a as (select n, len(ps) as dp, unnest(range(1, len(ps) + 1)) as k, ps from p), q as (select array_to_string(ps[1:k], '/') as wh, n, dp, k, ps[k + 1] as child from a),
      nd as (select wh, any_value(k) as k, sum(n)::bigint as total, sum(case when dp = k then n else 0 end)::bigint as own, count(distinct child) as ch from q group by wh), kp as (select * from nd where own > 0 or ch <> 1),
      pr as (select kp.wh, arg_max(u.wh, length(u.wh)) as up from kp join kp u on u.wh <> kp.wh and (starts_with(kp.wh, u.wh || '/')) group by kp.wh) select kp.wh as folder, case when up is null then kp.wh else substr(kp.wh, length(up) + 2) end as name, own, total from kp left join pr using (wh)""",
    "texts_translated": f"with {TRACKS} select seq, case seq % 4 when 1 then seq || ' Lieder' when 2 then 'all ' || seq || ' of ' || seq else 'k' || seq % 4 end as text from t",
    "browse_lists": f"""with {TRACK_STATS}, a as (select seq, row_number() over (order by last_played desc, seq) - 1 as pos from ts where last_played > 0), b as (select seq, row_number() over (order by seq) - 1 as pos from ts where rating >= 4),
      c as (select l_orderkey as id, l_partkey as seq, row_number() over (partition by l_orderkey order by l_linenumber * 10000000::bigint + l_partkey) - 1 as pos from lineitem join ts on seq = l_partkey)
      select 'recent' as list, pos::int as pos, seq from a where pos < 100 union all select 'loved', pos::int, seq from b where pos < 200 union all select 'pl:' || id, pos::int, seq from c where pos < 300""",
    "year_songs": f"""with {TRACK_STATS}, sg as (select title, plays, row_number() over (order by plays desc, seq) - 1 as pos from ts where plays > 0), w as (select coalesce(nullif(album_artist, ''), nullif(artist, '')) as name, sum(plays)::bigint as plays from ts where plays > 0 group by 1),
      v as (select *, row_number() over (order by plays desc, name) - 1 as pos from w where name is not null) select 'song' as kind, pos::int as pos, title as name, plays from sg where pos < 18 union all select 'artist', pos::int, name, plays from v where pos < 3""",
    "recent_history": f"with {TRACK_STATS} select seq, last_played from ts where plays > 0 and last_played > 0 order by last_played desc, seq limit 8",
    "scroll_labels": f"""with {TRACK_STATS} select seq, {_LETTER('title')} as title, {_LETTER('artist')} as artist, {_LETTER('album')} as album, case when year <> 0 then year::varchar else '—' end as year, floor(duration / 60)::bigint || 'm' as duration, case when rating > 0 then repeat('★', rating::int) else '—' end as rating,
      case when plays >= 100 then '100+' when plays >= 10 then '10+' else plays::varchar end as plays, case when mtime > 0 then strftime(make_timestamp((case when mtime > 1e12 then mtime / 1000 else mtime end * 1000000)::bigint), '%b %y') else '—' end as recent from ts""",
    "text_derivations": f"""with {TRACKS} select seq, case seq % 3 when 0 then 'audio/mpeg' when 1 then 'audio/flac' else 'application/octet-stream' end as mime, array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as capital, md5(path) as token,
      'https://genius.com/search?q=' || url_encode(artist || ' ' || title) as lyrics, case when seq % 2 = 0 then 'Music/' || seq end as tree, case seq % 3 when 0 then 'http://h:1/x' when 1 then 'http://h:1/y' else 'http://z/' end as url, '&lt;a b=&quot;c&quot;&gt;&amp;' || artist as xml from t""",
    "page_hosts": "select page_id, split_part(split_part(url, '://', 2), '/', 1) as host, case when regexp_matches(html, '(?s)<h1>.*?</h1>') then trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) end as head from pages",
    "colours": f"with {_PX}, {_HSL} select distinct r, g, b, h, s, l from c4",
    "colours_back": f"with {_PX} select distinct r, g, b, r as r2, g as g2, b as b2 from px",
    "vivid_hues": f"""with {_PX}, {_HSL}, w as (select id, h, s, (s / 100) * (s / 100) * (1 - abs(l - 55) / 55) as w, least(35, floor(h / 10)) as bin from c4 where a >= 8 and l >= 12 and l <= 92), g as (select id, bin, sum(w) as w, sum(h * w) as hw, sum(s * w) as sw from w where w > 0 group by 1, 2),
      o as (select *, row_number() over (partition by id order by w desc, bin) as rn from g) select id, hw / w as hue, greatest(35, least(95, sw / w)) as saturation from o where rn = 1""",
    "luminance": f"with {_PX} select id, avg((0.2126::double * r + 0.7152::double * g + 0.0722::double * b) / 255) as luminance from px where a >= 8 group by id",
    "crest_factors": f"with {_CU} select id, case when sqrt(avg(v * v)) > 1e-9 then 20 * log10(max(abs(v)) / sqrt(avg(v * v))) else 0 end as crest from cu group by id",
    "chroma_entropies": "with c as (select vec_id as id, unnest(list_transform(embedding[1:12], lambda z: abs(z::double))) as x from embeddings), t as (select *, sum(x) over (partition by id) as s from c) select id, -sum(case when x > 0 then x / s * ln(x / s) else 0 end) / ln(12.0::double) as entropy from t group by id",
    "envelopes": f"with {_CU} select id, floor(i * 10 / n)::bigint as bucket, min(v) as low, max(v) as high, sqrt(avg(v * v)) as rms from cu group by 1, 2",
    "onset_density": f"with {_CU}, q as (select *, lag(v) over w as was, lead(v) over w as nx, avg(v) over (partition by id) + stddev_pop(v) over (partition by id) as level from cu window w as (partition by id order by i)) select id, count(*) filter (v > level and v >= was and v > nx) * 43.0::double / count(*) as density from q group by id",
    "voted_tempos": f"""with {_FP}, h as (select id, bpm + 1 as bpm, k * 60.0::double / bpm + (id * k % 7 - 3) * 0.0003::double as t from fp, (select unnest(range(0, 41)) as k)), g as (select *, t - lag(t) over (partition by id order by t) as gap, 60.0::double / bpm as pd from h),
      v as (select *, floor(gap / pd + 0.5::double) as bt from g), w as (select *, case when bt between 1 and 4 and abs(gap / pd - bt) < 0.15::double then 60.0::double * bt / gap end as vote from v), x as (select *, floor((vote - (bpm - 8)) / 0.1::double + 0.5::double) as bin from w),
      c as (select id, bin, count(*) as c from x where bin >= 0 and bin < 160 group by 1, 2), p as (select id, bin from (select *, row_number() over (partition by id order by c desc, bin desc) as rn from c) where rn = 1),
      m as (select id, avg(vote) as mean, count(*) as n from x join p using (id) where abs(vote - (bpm - 8 + p.bin * 0.1::double)) <= 0.3::double group by id), n as (select id, count(vote) as votes, any_value(bpm) as bpm from x group by id)
      select id, case when votes >= 12 and m.n >= 8 and abs(mean - bpm) <= 0.06::double * bpm then mean else bpm end as bpm from n left join m using (id)""",
    "genre_features": f"""with {_RAW}, f as (select id, bpm, {_UNIT('v[41]')} as low, {_UNIT('v[42]')} as mid, {_UNIT('v[40] / 6.0::double')} as onset, {_UNIT('v[27] / (11025.0::double * 0.45::double)')} as bright, {_UNIT('v[29] / (11025.0::double * 0.85::double)')} as air, {_UNIT('v[33]')} as flat, {_UNIT('v[37] / 0.2::double')} as zcr,
      {_UNIT('(v[43] - 6.0::double) / 14.0::double')} as dynamics, {_UNIT('v[44] / 2.484907::double')} as atonal, {_UNIT('tc')} as steady from rw), g as (select *, {_UNIT('0.45::double * onset + 0.30::double * low + 0.25::double * (1 - dynamics)')} as energy from f)
      select *, concat_ws(',', case when steady > 0.6::double and onset > 0.45::double and bpm between 118 and 138 then 'four-on-floor' end, case when id % 5 = 0 then 'half-time' end, case when low > 0.55::double then 'bass-heavy' end, case when bright > 0.55::double then 'bright' when bright < 0.3::double then 'dark' else 'balanced' end,
        case when atonal > 0.6::double then 'atonal' else 'melodic' end, case when flat > 0.55::double then 'noisy' end, case when dynamics > 0.6::double then 'dynamic' end, case when energy > 0.6::double then 'high-energy' when energy < 0.3::double then 'chilled' end) as tags from g""",
    "corrective_curves": f"""with {_L}, m as (select id, lv, list_avg(lv) as m from lv), g as (select id, unnest(range(0, 10)) as band, unnest(list_transform(range(1, 11), lambda i: greatest(-6, least(6, floor((list_extract({_HOUSE}::double[], i) - (lv[i] - m)) * 0.5::double * 2 + 0.5::double) / 2)))) as gain from m)
      select id, band::int as band, gain, greatest(-12, -(floor(greatest(0, max(gain) over (partition by id)) * 2 + 0.5::double) / 2)) as preamp from g""",
    "curve_response": f"with {_L}, b as (select id, unnest(lv) as g, unnest(range(0, 10)) as i from lv) select id, -1.5::double + sum(g * exp(-0.5::double * pow((3.0::double - log10(31.25::double * pow(2, i))) * (greatest(0.25::double, 0.1::double + 0.2::double * i) + 0.4::double) / 0.34::double, 2))) as db from b group by id",
    "centroids_merged": f"""with {_FP}, l as (select label as g, 1.0::double + id % 5 as mass, unnest(v) as x, unnest(range(0, len(v))) as dim from fp), m as (select g, dim, sum(x * mass) / sum(mass) as x from l group by 1, 2), n as (select g, sqrt(sum(x * x)) as n from m group by g),
      q as (select label as g, sum(1.0::double + id % 5) as mass, sum(bpm * (1.0::double + id % 5)) / sum(1.0::double + id % 5) as bpm from fp group by 1) select m.g, mass, bpm, dim::int as dim, x / n as x from m join n using (g) join q using (g)""",
    "taste_counts": "select (select count(*) from embeddings) as tracks, (select count(distinct label) from embeddings) as clusters, (select count(*) from events) as events",
}
