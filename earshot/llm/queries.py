"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, collocations, decontaminate, filter_audit, html_text, jaccard, language_model, line_dedup, mixing, pieces, quality, url_filter, warc
from .common import materialize, read


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.near_components(read(spark, sf_dir, "documents"))


def op2_html_text(spark, sf_dir):
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op3_warc(spark, sf_dir):
    return warc.archive_digests(read(spark, sf_dir, "pages"))


def op4_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("rid")


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_lines")


def op7_language_model(spark, sf_dir):
    return language_model.score(read(spark, sf_dir, "documents"))


def op8_chat_quotes(spark, sf_dir):
    return chat.reply_order(read(spark, sf_dir, "conversations"))


def op9_url_filter(spark, sf_dir):
    return url_filter.filtered_pages(read(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    measured = materialize(quality.quality_measures(docs), "quality-measures")
    return quality.quality_rules(docs, measured).drop("lang", "source")


def op11_piece_encoding(spark, sf_dir):
    return pieces.digests(read(spark, sf_dir, "documents"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_html_text, op3_warc, op4_mix_sources, op5_decontaminate, op6_line_dedup, op7_language_model, op8_chat_quotes, op9_url_filter, op10_quality_rules, op11_piece_encoding, op12_collocations, op13_filter_audit)}

ORACLE = {
    "op4_mix_sources": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, 'null')) as k from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
s1 as (select source, source_size, case i % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w from s0),
s2 as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / w as ratio from s1),
s3 as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as level from s2),
lv as (select min_by(level, ratio) as level from s3 where not ratio <= s3.level),
t as (select source, source_size, case when ratio <= s3.level then cap else w * (select level from lv) end as target from s3),
x as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target + 1e-6)::bigint as budget,
    (coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0))::bigint as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) else 0 end)::bigint as taken
from x""",
    "op6_line_dedup": r"""
with d as (select doc_id, string_split(text, chr(10)) as ls, text from documents),
l as (select doc_id, ls, list_filter(range(0, len(ls)), lambda i: regexp_matches(ls[i + 1], '[^\x20\x09-\x0D]')) as a from d where text is not null),
w as (select doc_id, a, p, ls[a[p] + 1] as x, ls[a[p + 1] + 1] as y, ls[a[p + 2] + 1] as z from (select doc_id, ls, a, unnest(range(1, len(a) - 1)) as p from l)),
n as (select *, row_number() over (partition by x, y, z order by doc_id, p) as rn from w),
c as (select doc_id, list_distinct(flatten(list(range(a[p], a[p + 2] + 1)))) as gone from n where rn > 1 group by doc_id)
select d.doc_id,
  case when c.gone is null then d.text else coalesce(array_to_string(list_transform(list_filter(range(0, len(d.ls)), lambda i: not list_contains(c.gone, i)), lambda i: d.ls[i + 1]), chr(10)), '') end as text,
  coalesce(len(c.gone), 0)::bigint as n_removed_lines
from d left join c using (doc_id)""",
    "op9_url_filter": url_filter.SQL,
    "op12_collocations": collocations.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
