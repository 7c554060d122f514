"""Queries on recordings in mixes, by landmarks, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators import landmarks as lm
from earshot.sources.tables import read


def curves(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Mixes and recordings made from events: each event is a second with twelve bands, a listener's events are a recording, and two of three listeners of fifteen follow each other in a mix, a little changed."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.md5(F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("h"))
    six = lambda a: F.conv(F.substring("h", a, 12), 16, 10).cast("long")
    e = e.select("user_id", "event_id", six(1).alias("x"), six(13).alias("y"))
    e = e.select("user_id", "event_id", F.array(*[F.shiftright(c, 41 - 8 * i).bitwiseAND(F.lit(127)).cast("int") for c in ("x", "y") for i in range(6)]).alias("b"))
    frames = lambda by, order, b: F.sort_array(F.collect_list(F.struct(*order, b.alias("b"))))["b"]
    recordings = e.groupBy(F.col("user_id").alias("id")).agg(frames("id", ["event_id"], F.col("b")).alias("frames"))
    noisy = F.transform("b", lambda x, i: x + F.pmod(F.col("event_id") + i, F.lit(7)).cast("int"))
    mixes = e.where("user_id % 3 <> 0").groupBy((F.lit(1_000_000) + F.floor(F.col("user_id") / 15)).alias("id")).agg(frames("id", ["user_id", "event_id"], noisy).alias("frames"))
    sized = lambda df: df.select("id", F.size("frames").cast("double").alias("length"), "frames")
    return sized(mixes), sized(recordings)


def _votes(spark, sf_dir):
    mixes, recordings = curves(spark, sf_dir)
    found = lm.votes(lm.landmarks(mixes.where("length >= 480")), lm.landmarks(recordings))
    return found.where(F.col("votes") >= lm.LEAST_VOTES).withColumn("rank", F.row_number().over(Window.partitionBy("mix").orderBy(F.desc("votes"), "id", "off"))).where("rank <= 20")


QUERIES = {
    "mix_landmarks": lambda s, d: lm.landmarks(curves(s, d)[1]),
    "mix_votes": _votes,
    "mix_hits": lambda s, d: lm.hits(*curves(s, d)),
    "mix_contents": lambda s, d: lm.without_overlaps(lm.hits(*curves(s, d))),
}

_CURVES = """
e as (select user_id, event_id, md5('f' || event_id) as h from events),
b as (select user_id, event_id, list_transform(range(0, 12), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::int // 2) as b from e),
rf as (select user_id as id, row_number() over (partition by user_id order by event_id) - 1 as sec, b from b),
mf as (select 1000000 + user_id // 15 as id, row_number() over (partition by user_id // 15 order by user_id, event_id) - 1 as sec, list_transform(b, lambda x, i: (x + (event_id + i - 1) % 7)::int) as b from b where user_id % 3 <> 0),
f as (select * from rf union all select m.* from mf m where id in (select id from mf group by id having count(*) >= 480)),
p as (select id, sec, list_reverse_sort(list_transform(range(1, 13), lambda i: (b[i] - was[i]) * 100 + (100 - i))) as s from (select *, lag(b) over (partition by id order by sec) as was from f) where was is not null),
k as (select id, sec - 1 as at, case when s[1] >= 100 and s[12] < 0 then ((99 - s[1] % 100) * 100 + (99 - (s[2] % 100 + 100) % 100)) * 100 + (99 - (s[12] % 100 + 100) % 100) end as p from p),
lm as (select a.id, a.at, (a.p::bigint * 1000000 + b.p) * 10 + (b.at - a.at) as key from k a join k b on a.id = b.id and b.at - a.at between 1 and 3 where a.p is not null and b.p is not null),
v as (select m.id as mix, r.id, m.at - r.at as off, count(*) as votes from lm m join lm r using (key) where m.id >= 1000000 and r.id < 1000000 and m.at >= r.at group by 1, 2, 3 having count(*) >= 4)"""
_HITS = f"""{_CURVES},
n as (select id, count(*) as n from f group by id),
t as (select v.*, least(r.n, m.n - off) as overlap from (select *, max(votes) over (partition by mix, id) as best from v) v join n r on r.id = v.id join n m on m.id = mix where votes >= 0.5 * best and r.n >= 25 and r.n < m.n and least(r.n, m.n - off) >= 25),
c as (select mix, t.id, off, overlap, sum(list_sum(list_transform(range(1, 13), lambda i: (x.b[i] * y.b[i])::double)) / sqrt(list_sum(list_transform(x.b, lambda q: (q * q)::double)) * list_sum(list_transform(y.b, lambda q: (q * q)::double)))) / overlap as score
  from t join rf x on x.id = t.id join mf y on y.id = mix and y.sec = off + x.sec group by mix, t.id, off, overlap)"""
ORACLE = {
    "mix_landmarks": f"with {_CURVES} select * from lm where id < 1000000",
    "mix_votes": f"with {_CURVES} select *, row_number() over (partition by mix order by votes desc, id, off) as rank from v qualify rank <= 20",
    "mix_hits": f"with {_HITS} select mix, id, off as start, off + overlap as finish, score from c where score >= 0.84 qualify row_number() over (partition by mix, id order by score desc, off) = 1",
}
