"""Pieces of SQL that the queries' SQL shares: the logical tables and the parts of scores."""

from __future__ import annotations

NOW = 1_706_572_800

TRACKS = """t as (select '/lib/' || p_type || '/' || p_brand || '/' || p_partkey || '.mp3' as path, p_name as title, p_brand as artist, p_brand || ' ' || p_type as album,
  case when p_partkey % 3 = 0 then 'VA ' || p_brand end as album_artist, p_type as genre, 1950 + p_size as year, 60.0::double + p_size * 10 as duration,
  (1706572800 - p_partkey * 3600)::double as mtime, p_partkey as seq from part)"""
STATS = """s as (select l_partkey as seq, count(*) as plays, max(epoch(l_shipdate))::bigint as last_played, least(10, count(*) filter (l_returnflag = 'R'))::bigint as skips,
  (1 + l_partkey % 5)::bigint as rating from lineitem group by l_partkey)"""
TRACK_STATS = f"{TRACKS}, {STATS}, ts as (select t.*, coalesce(plays, 0) as plays, coalesce(last_played, 0) as last_played, coalesce(skips, 0) as skips, coalesce(rating, 0) as rating from t left join s using (seq))"
EVENTS = """e as (select json_extract_string(props, '$.k')::bigint as track, case event_type when 'purchase' then 'Like' when 'signup' then 'AddedManually' when 'view' then 'FullPlay' when 'click' then 'SkipMid' when 'error' then 'SkipEarly' end as kind,
  floor(epoch(ts))::bigint as ts, event_id as seq from events)"""

BASE = "(plays + case when rating >= 4 then 3.0 when rating between 1 and 2 then -2.0 else 0.0 end::double - 0.5::double * skips)"
PART = f"{BASE} * (0.3::double + 0.7::double * case when last_played > 0 then pow(0.5::double, greatest(0.0, ({NOW} - last_played) / 86400.0::double) / 30) else 0 end)"
WHO = "coalesce(nullif(album_artist, ''), nullif(artist, ''), '')"
