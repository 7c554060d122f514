"""Queries that keep a library, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import recommend as r
from earshot.operators import upkeep as u
from earshot.plans.models import _COS, _FP
from earshot.plans.sql import EVENTS, NOW, TRACK_STATS, TRACKS
from earshot.sources.tables import fingerprints, listens, read, stats, tracks


def _patches(s, d):
    """A patch a track of the last century's second half: some titles cleared, some artists set."""
    t = tracks(s, d).where("year >= 1970")
    return t.select("path", F.when(F.col("year") < 1980, "").when(F.col("year") < 1990, "New").alias("title"), F.when(F.col("year") >= 1985, "Someone").alias("artist"))


def _queue(s, d):
    """Orders as saved queues; the dearest item is the current one."""
    q = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("seq")).agg(F.min("l_linenumber").alias("n"), F.max("l_extendedprice").alias("price"))
    w = u.Window.partitionBy("id")
    return q.select("id", "seq", (F.col("n") * 10_000_000 + F.col("seq")).alias("pos"), (F.col("price") == F.max("price").over(w)).alias("current"))


def _seeds(s):
    return s.createDataFrame([(3,), (7,), (11,)], "id long")


QUERIES: dict = {
    "tags_patched": lambda s, d: u.patched(tracks(s, d), _patches(s, d)).select("path", "title", "artist"),
    "tags_filled": lambda s, d: u.patched(tracks(s, d).withColumn("artist", F.when(F.col("year") > 1990, "Unknown Artist").otherwise(F.col("artist"))), _patches(s, d), only_missing=True).select("path", "title", "artist"),
    "library_append": lambda s, d: u.append_unseen(tracks(s, d).where("year < 1980").select("path", "title"), tracks(s, d).where("year > 1970").select("path", F.lit("again").alias("title"))),
    "folder_removed": lambda s, d: u.without_folder(tracks(s, d), "/lib/PROMO").select("path"),
    "not_heard_since": lambda s, d: u.not_heard_since(fingerprints(s, d), listens(s, d), NOW - 86_400 * 3).select("id"),
    "analysis_order": lambda s, d: u.analysis_order(r.with_stats(tracks(s, d), stats(s, d)), tracks(s, d).where("year > 1980")).select("seq", "priority"),
    "restored_queue": lambda s, d: u.restored_queue(_queue(s, d), tracks(s, d).where("year < 1990")),
    "similarity_order": lambda s, d: u.by_similarity(_queue(s, d), tracks(s, d).where("year < 1990").select("seq", (F.col("year") * 1_000_000 + F.col("seq")).alias("rank"))),
    "similar_to_each": lambda s, d: u.similar_to_each(fingerprints(s, d), _seeds(s), 30),
    "recipe": lambda s, d: u.recipe(fingerprints(s, d), _seeds(s), fingerprints(s, d).select("id", ((F.col("label") - 4.5) / 10).alias("score")), 60),
}

_PA = f"{TRACKS}, p as (select path, case when year < 1980 then '' when year < 1990 then 'New' end as nt, case when year >= 1985 then 'Someone' end as na from t where year >= 1970)"
_Q = "q as (select l_orderkey as id, l_partkey as seq, min(l_linenumber) as n, max(l_extendedprice) as price from lineitem group by 1, 2), qq as (select id, seq, n * 10000000::bigint + seq as pos, price = max(price) over (partition by id) as current from q)"

ORACLE: dict[str, str] = {
    "tags_patched": f"with {_PA} select path, case when nt is null then title else nullif(nt, '') end as title, coalesce(na, artist) as artist from t left join p using (path)",
    "tags_filled": f"with {_PA} select path, title, case when year > 1990 then na else artist end as artist from t left join p using (path)",
    "library_append": f"with {TRACKS} select path, case when year < 1980 then title else 'again' end as title from t",
    "folder_removed": f"with {TRACKS} select path from t where not starts_with(path, '/lib/PROMO/')",
    "not_heard_since": f"with {EVENTS} select vec_id as id from embeddings where vec_id not in (select track from e where ts > {NOW - 86_400 * 3} - 28800 and track is not null)",
    "analysis_order": f"with {TRACK_STATS} select seq, case when rating >= 4 then 1000000.0 else 0 end::double + plays * 1000.0::double + case when last_played > 0 then 100 else 0 end as priority from ts where year <= 1980",
    "restored_queue": f"with {TRACKS}, {_Q} select id, (row_number() over (partition by id order by pos) - 1)::int as place, seq, current from qq join (select seq from t where year < 1990) using (seq)",
    "similarity_order": f"with {TRACKS}, {_Q} select id, seq, (row_number() over (partition by id order by case when year < 1990 then year * 1000000::bigint + seq else 1000000000 end, pos) - 1)::int as place from qq join t using (seq)",
    "similar_to_each": f"with {_FP}, s as (select id as seed, v as q from fp where id in (3, 7, 11)), x as (select seed, id, {_COS('v', 'q')} as sim from fp, s where id <> seed) select seed, id, sim from (select *, row_number() over (partition by seed order by sim desc, id) as rn from x) where rn <= 30",
    "recipe": f"with {_FP}, s as (select id as seed, v as q from fp where id in (3, 7, 11)), x as (select id, label, max({_COS('v', 'q')}) as near from fp, s group by id, label) select id, 0.75::double * near + 0.25::double * (label - 4.5::double) / 10 + case when id in (3, 7, 11) then 1 else 0 end as score from x order by score desc, id limit 60",
}
