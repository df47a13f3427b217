"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprints, media, mixing, ngram_join, packing, quality, sharding, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        chat.op1_tool_chat, quality.op2_quality_cnn, suffix_dedup.op3_suffix_columns, ngram_join.op4_ngram_join, ngram_join.op4_ngram_links, toxicity.op5_toxicity_mil,
        sharding.op6_slot_sharding, media.op7_gif_columns, packing.op8_pack_binary, fingerprints.op9_simhash, mixing.op10_mix_sources,
    )
}

OP3_SQL = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
w as (select r, doc_id, i, sha256(b[i + 1 : i + 400]) as h from (select r, doc_id, b, unnest(range(0, octet_length(b) - 399)) as i from d where octet_length(b) >= 400)),
k as (select r, i from (select r, i, count(*) over (partition by h) as c from w) where c > 1),
e as (select r, i, i - lag(i) over (partition by r order by i) as gap from k),
g as (select r, i, sum(case when gap is null or gap > 400 then 1 else 0 end) over (partition by r order by i) as s from e),
spans as (select r, s, min(i) as a, max(i) + 400 as z from g group by r, s),
rests as (select r, a as upto, coalesce(lag(z) over (partition by r order by a), 0) as start, z from spans),
pieces as (
  select r, start, upto from rests
  union all select d.r, coalesce(max(z), 0), octet_length(any_value(b)) from d left join spans using (r) group by d.r),
kept as (select r, string_agg(substr(hex(b), 2 * start + 1, 2 * (upto - start)), '' order by start) as x from pieces join d using (r) group by r),
n as (select r, sum(z - a) as removed, count(*) as n from spans group by r),
w2 as (select r, i, sha256(b[i + 1 : i + 250]) as h from (select r, doc_id, b, unnest(range(0, octet_length(b) - 249)) as i from d where octet_length(b) >= 250)),
k2 as (select r, i from (select r, i, count(*) over (partition by h) as c from w2) where c > 1),
e2 as (select r, i, i - lag(i) over (partition by r order by i) as gap from k2),
n2 as (select r, sum(case when gap is null or gap > 250 then 250 else gap end) as passage from e2 group by r)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
  cast(coalesce(n, 0) as bigint) as n_spans, sha256(unhex(coalesce(x, ''))) as kept_sha256, cast(coalesce(passage, 0) as bigint) as n_passage
from d left join n using (r) left join kept using (r) left join n2 using (r)
"""

OP4_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as x from documents),
s as (
  select distinct doc_id, case when len(x) >= 4 then x[i : i + 3] else x end as g
  from (select doc_id, x, unnest(range(1, greatest(len(x) - 2, 2))) as i from w where len(x) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
e as (select a, b from l union select b, a from l),
c as (select a as doc_id, a as to_id from e union select c.doc_id, e.b from c join e on c.to_id = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join (select doc_id, min(to_id) as low from c group by doc_id) m using (doc_id)
"""

ORACLES: dict[str, str] = {"op1_tool_chat": chat.OP1_SQL, "op3_suffix_columns": OP3_SQL, "op4_ngram_join": OP4_SQL}
