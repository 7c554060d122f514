"""Described-sound queries over the texts of conversations, by a small lexicon of this file's own, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import described as ds
from earshot.sources.tables import read

TERMS = [(0, "energetic", 120, None), (1, "chill", None, 110), (2, "dark", None, None), (3, "fast", 130, None)]
TRIGGERS = [(0, 0, "energy"), (0, 1, "data"), (1, 0, "calm"), (1, 1, "easy"), (2, 0, "dark"), (2, 1, "model"), (3, 0, "fast"), (3, 1, "query")]
PUSHES = [(0, "flux", 1.0), (0, "onset", 1.0), (1, "flux", -1.0), (1, "rms", -0.5), (2, "centroid", -1.0), (2, "low", 0.5), (3, "onset", 0.4)]
SYNONYMS = [("table", "data"), ("stream", "fast"), ("night", "dark"), ("quiet", "calm")]


def _lexicon(s):
    make = s.createDataFrame
    return (make(TERMS, "term int, label string, bpm_min int, bpm_max int"), make(TRIGGERS, "term int, place int, word string"),
            make(PUSHES, "term int, feature string, weight double"), make(SYNONYMS, "word string, trigger string"))


def _texts(s, d):
    """One text a message; a word of tempo is put in by the turn."""
    c = read(s, d, "conversations")
    text = F.concat_ws(" ", F.when(F.col("turn") % 3 == 0, "so dark").when(F.col("turn") % 3 == 1, "not"), F.col("text"), F.when(F.col("turn") % 4 == 1, F.concat(F.col("turn") + 90, F.lit("-140 bpm"))))
    return c.select(F.concat_ws(":", "conv_id", "turn", F.md5(F.coalesce("text", F.lit("")))).alias("id"), text.alias("text")).distinct()


def _named(s, d):
    """Terms by triggers alone, without synonyms, which SQL can follow."""
    terms, triggers, _, _ = _lexicon(s)
    t = _texts(s, d).select("id", F.lower(F.coalesce("text", F.lit(""))).alias("q"))
    return ds.matches(t.withColumn("said", F.col("q")), terms, triggers)


def _expanded(s, d):
    _, triggers, _, synonyms = _lexicon(s)
    return ds.expanded(_texts(s, d), triggers, synonyms)


QUERIES: dict = {
    "described_terms": lambda s, d: _named(s, d).select("id", "label", "strength"),
    "described_weights": lambda s, d: ds.weights(_named(s, d), _lexicon(s)[2]),
    "described_windows": lambda s, d: ds.windows(_named(s, d)),
    "described_expanded": _expanded,
}

_VALUES = lambda rows: ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in r) + ")" for r in rows)
_ENDS = lambda ws: "(" + " or ".join(f"ends_with(bf, '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + ")"
_T = f"""x as (select distinct concat_ws(':', conv_id::varchar, turn::varchar, md5(coalesce(text, ''))) as id, lower(concat_ws(' ', case turn % 3 when 0 then 'so dark' when 1 then 'not' end, text, case when turn % 4 = 1 then (turn + 90) || '-140 bpm' end)) as q from conversations),
  te(term, label, lo, hi) as (values {_VALUES(TERMS)}), tg(term, place, word) as (values {_VALUES(TRIGGERS)}), pu(term, feature, weight) as (values {_VALUES(PUSHES)}),
  ht as (select id, q, term, arg_min(word, place) as hit from x join tg on contains(q, word) group by 1, 2, 3),
  bf as (select *, instr(q, hit) as p, substr(q, greatest(1, instr(q, hit) - 16)::bigint, least(16, instr(q, hit) - 1)::bigint) as bf from ht),
  nm as (select id, q, term, label, lo, hi, case when p <= 1 then 1.0 when {_ENDS(ds.NEGATE)} then -1.0 when {_ENDS(ds.INTENSIFY)} then 1.6 when {_ENDS(ds.SOFTEN)} then 0.5 else 1.0 end::double as strength from bf join te using (term))"""

ORACLE: dict[str, str] = {
    "described_terms": f"with {_T} select id, case when strength < 0 then 'not ' when strength > 1 then 'very ' when strength < 1 then 'slightly ' else '' end || label as label, strength from nm",
    "described_weights": f"with {_T}, w as (select id, feature, sum(weight::double * strength) as w from nm join pu using (term) group by 1, 2) select id, feature, greatest(-2, least(2, w)) as weight from w where w <> 0",
    "described_windows": f"""with {_T}, w as (select id, q, coalesce(max(case when strength > 0 then lo end), 0) as lo, coalesce(min(case when strength > 0 then hi end), 0) as hi from nm group by 1, 2),
      v as (select id, try_cast(regexp_extract(q, '(\\d{{2,3}})-140 bpm', 1) as int) as a, lo, hi from w), u as (select id, case when a is not null then least(a, 140) else lo end as lo, case when a is not null then greatest(a, 140) else hi end as hi from v)
      select id, case when lo > 0 and hi > 0 and lo > hi then 0 else lo end::int as lo, case when lo > 0 and hi > 0 and lo > hi then 0 else hi end::int as hi from u""",
}
