"""Queries of the directory-plan engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, paths, text
from ..operators import dedup, extract, plan, progress, tree
from ..sources import copy, store

Query = Callable[[SparkSession, str], DataFrame]

# The virtual tables, the same text in both engines.
DOC_MANIFEST = """
select doc_id,
  case when doc_id % 31 = 0 then 'root-' || cast(doc_id as varchar(20)) || '-' || name
       else lang || '/' || source || '/v' || cast(doc_id as varchar(20)) ||
            case when doc_id % 37 = 0 then '/.Trashes/' else '/in/' end || name end as rel,
  text
from (
  select doc_id, lang, source, text,
    case when doc_id % 29 = 0 then '._' else '' end ||
    case when doc_id % 2 = 0 then 'doc' else 'Doc' end || '_' || cast(doc_id % 3 as varchar(9)) ||
    case doc_id % 8 when 0 then '.txt' when 1 then '.md' when 2 then '.PDF' when 3 then '.tar.gz'
                    when 4 then '' when 5 then '.JPG' when 6 then '.json' else '.xyzzy' end as name
  from documents) n
"""
PAGE_MANIFEST = """
select page_id, regexp_replace(regexp_replace(regexp_replace(
  url, '^https?://', ''), '[?#].*$', ''), '/+$', '') as rel from pages
"""
EXCLUSIONS = ["de", "en/src3", "en/src3/v63", "fr/src5"]
EXPANDED = ["de", "de/src1", "en", "fr/src2"]
#: Events are this much faster than in the table, so that some come before the next sample is due.
FASTER = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(spark: SparkSession, sf_dir: str, name: str, query: str) -> DataFrame:
    """query over one table, given to it as an argument, so that no view is left behind."""
    return spark.sql(query.replace(f"from {name}", f"from {{{name}}}"), **{name: table(spark, sf_dir, name)})


def doc_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, "documents", DOC_MANIFEST)


def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, "pages", PAGE_MANIFEST)


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned manifest with seq and src."""
    return plan.ordered(plan.pruned(doc_manifest(spark, sf_dir).drop("text")), F.col("doc_id")).withColumn("src", F.col("rel"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in EXCLUSIONS], "path string")


def doc_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.entries(doc_manifest(spark, sf_dir))


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, seq, written, bytes, elapsed_ns): each event type is a job."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("written"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.groupBy("job").agg(F.min("us").alias("began"))
    e = e.join(F.broadcast(first), "job").withColumn("elapsed_ns", F.call_function("div", (F.col("us") - F.col("began")) * 1000, F.lit(FASTER).cast("long")))
    return progress.running_bytes(e.select("job", "seq", "written", "elapsed_ns")).withColumnRenamed("total", "bytes")



META_SQL = "(starts_with(lower({n}), '._') or lower({n}) in (" + ", ".join(f"'{n}'" for n in dims.METADATA_NAMES) + "))"
EXT_SQL = """case when not contains(regexp_replace({n}, '^\\.', ''), '.') then ''
  when regexp_extract(lower(regexp_replace({n}, '^\\.', '')), '\\.(tar\\.(gz|bz2|xz|zst|lz4))$', 1) <> '' then regexp_extract(lower(regexp_replace({n}, '^\\.', '')), '\\.(tar\\.(gz|bz2|xz|zst|lz4))$', 1)
  else lower(string_split({n}, '.')[-1]) end"""
CATEGORY_SQL = "cats(category, exts) as (values " + ", ".join(f"('{c}', '{e}')" for c, e in dims.CATEGORIES.items()) + "), dim as (select category, unnest(string_split(exts, ' ')) as ext from cats)"
MANIFEST_SQL = f"manifest as ({DOC_MANIFEST}), named as (select *, string_split(rel, '/')[-1] as name, string_split(rel, '/') as p from manifest)"
PRUNED_SQL = MANIFEST_SQL + ", pruned as (select *, row_number() over (order by p, doc_id) - 1 as seq from named where len(list_filter(p, lambda x: " + META_SQL.format(n="x") + ")) = 0)"
UP_SQL = "list_transform(range(1, len({p})), lambda i: array_to_string({p}[1:i], '/'))"
ENTRIES_SQL = (
    MANIFEST_SQL
    + f", dirs as (select distinct unnest({UP_SQL.format(p='p')}) as rel from named), ent as (select rel, 'file' as kind from manifest union all select rel, 'dir' from dirs)"
    + ", entries as (select rel, kind, string_split(rel, '/')[-1] as name, case when contains(rel, '/') then regexp_replace(rel, '/[^/]*$', '') else '' end as parent from ent)"
)
UNIQUE_SQL = """
, split as (select seq, src, dst, regexp_extract(dst, '(\\.[^./]*)$', 1) as ext from dsts),
fams as (select seq, src, dst, ext, left(dst, length(dst) - length(ext)) as base,
  regexp_replace(lower(left(dst, length(dst) - length(ext))), '(_[0-9]+)+$', '') || '|' || lower(ext) as fam from split),
ranked as (select *, row_number() over (partition by fam order by seq) as rn from fams),
grown(fam, rn, keys, seq, src, dst) as (
  select distinct fam, cast(0 as bigint), cast([] as varchar[]), cast(null as bigint), cast(null as varchar), cast(null as varchar) from ranked
  union all
  select fam, rn, list_append(keys, lower(dst)), seq, src, dst from (
    select r.fam, r.rn, g.keys, r.seq, r.src, list_filter(list_transform(range(0, len(g.keys) + 1), lambda i: case when i = 0 then r.dst else r.base || '_' || i || r.ext end),
      lambda c: not list_contains(g.keys, lower(c)))[1] as dst
    from grown g join ranked r on r.fam = g.fam and r.rn = g.rn + 1))
select seq, src, dst from grown where rn > 0
"""
LOG_SQL = f"""ev as (select event_type as job, event_id as seq, cast(round(value * 100) as bigint) as written, epoch_us(ts) as us from events),
log as (select job, seq, written, ((us - min(us) over (partition by job)) * 1000) // {FASTER} as elapsed_ns,
  cast(sum(written) over (partition by job order by seq) as bigint) as bytes from ev)"""
SETS_SQL = """f as (select doc_id as seq, octet_length(encode(text)) as size, encode(text) as b from documents where octet_length(encode(text)) > 0),
s1 as (select *, count(*) over (partition by size) as k from f), c1 as (select * from s1 where k > 1),
s2 as (select *, sha256(b[1:{head}]) as ph from c1), s3 as (select *, count(*) over (partition by size, ph) as k2 from s2), c2 as (select * from s3 where k2 > 1),
s4 as (select seq, size, case when size <= {head} then ph else sha256(b) end as fh from c2),
sets as (select size, min(seq) as keep, list(seq order by seq)[2:] as skip from s4 group by size, fh having count(*) > 1)"""
HUMAN_SQL = "case " + " ".join(f"when {{n}} >= {1000 ** (i + 1)} then printf('%.1f', {{n}} / {float(1000 ** (i + 1))!r}) || ' {u}'" for i, u in reversed(list(enumerate(text.UNITS)))) + " else {n} || ' B' end"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"with {MANIFEST_SQL} select doc_id, rel, row_number() over (order by p, doc_id) - 1 as seq from named")
def walk_order(spark, sf):
    return plan.ordered(doc_manifest(spark, sf), F.col("doc_id")).select("doc_id", "rel", "seq")


@query(f"with {MANIFEST_SQL} select doc_id, name, {META_SQL.format(n='name')} as is_meta from named")
def metadata_flags(spark, sf):
    name = paths.name(F.col("rel"))
    return doc_manifest(spark, sf).select("doc_id", name.alias("name"), dims.is_metadata(name).alias("is_meta"))


@query(f"with {PRUNED_SQL} select doc_id, rel from pruned")
def metadata_prune(spark, sf):
    return plan.pruned(doc_manifest(spark, sf)).select("doc_id", "rel")


@query(f"with {MANIFEST_SQL}, ex(path) as (values {', '.join(f'({p!r})' for p in EXCLUSIONS)}) select doc_id, rel from manifest m where not exists (select 1 from ex where starts_with(m.rel, ex.path || '/'))")
def exclude_subtree(spark, sf):
    return plan.without_subtrees(doc_manifest(spark, sf).select("doc_id", "rel"), exclusions(spark)).select("doc_id", "rel")


@query(f"with {ENTRIES_SQL}, ex(path) as (values {', '.join(f'({p!r})' for p in EXCLUSIONS)}) select rel as path, exists (select 1 from ex where rel = ex.path or starts_with(rel, ex.path || '/')) as excluded from dirs")
def effective_exclusion(spark, sf):
    dirs = doc_tree(spark, sf).where("kind = 'dir'").select(F.col("rel").alias("path"))
    return tree.effectively_excluded(dirs, exclusions(spark))


@query(f"with {ENTRIES_SQL}, ex as (select distinct rel as path from dirs where length(rel) % 3 = 0) select path from ex a where not exists (select 1 from ex b where starts_with(a.path, b.path || '/'))")
def exclusion_antichain(spark, sf):
    return plan.antichain(doc_tree(spark, sf).where("kind = 'dir' and length(rel) % 3 = 0").select(F.col("rel").alias("path")))


@query(f"with {PRUNED_SQL} select seq, rel as src, case when len(p) = 1 then name else p[-2] || '_' || name end as dst from pruned")
def plan_flat_names(spark, sf):
    return plan.flattened(doc_rows(spark, sf)).select("seq", "src", "dst")


@query(f"with recursive {PRUNED_SQL}, dsts as (select seq, rel as src, case when len(p) = 1 then name else p[-2] || '_' || name end as dst from pruned) {UNIQUE_SQL}")
def plan_flatten(spark, sf):
    return plan.assign_unique(plan.flattened(doc_rows(spark, sf)))


@query(f"with {MANIFEST_SQL}, x as (select doc_id, name, {EXT_SQL.format(n='name')} as ext from named) select doc_id, name, ext, case when ext = '' then 'no-extension' else ext end as folder from x")
def ext_classify(spark, sf):
    name = paths.name(F.col("rel"))
    ext = paths.extension(name)
    return doc_manifest(spark, sf).select("doc_id", name.alias("name"), ext.alias("ext"), paths.ext_folder(ext).alias("folder"))


@query(f"with {CATEGORY_SQL}, {MANIFEST_SQL}, x as (select doc_id, {EXT_SQL.format(n='name')} as ext from named) select doc_id, ext, coalesce(category, 'Other') as category from x left join dim using (ext)")
def category_lookup(spark, sf):
    return dims.with_category(doc_manifest(spark, sf).select("doc_id", paths.extension(paths.name(F.col("rel"))).alias("ext")))


@query(f"with {CATEGORY_SQL} select category, count(*) as n_exts from dim group by category")
def categories(spark, sf):
    return dims.category_table(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n_exts"))


@query(f"with {CATEGORY_SQL}, {PRUNED_SQL}, x as (select {EXT_SQL.format(n='name')} as ext, octet_length(encode(text)) as size from pruned) select coalesce(category, 'Other') as category, count(*) as files, cast(sum(size) as bigint) as bytes from x left join dim using (ext) group by all")
def category_rollup(spark, sf):
    rows = plan.pruned(doc_manifest(spark, sf)).select(paths.extension(paths.name(F.col("rel"))).alias("ext"), F.octet_length("text").cast("long").alias("size"))
    return dims.with_category(rows).groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"with recursive {CATEGORY_SQL}, {PRUNED_SQL}, x as (select *, {EXT_SQL.format(n='name')} as x from pruned), dsts as (select seq, rel as src, coalesce(category, 'Other') || '/' || case when x = '' then 'no-extension' else x end || '/' || name as dst from x left join dim on dim.ext = x.x) {UNIQUE_SQL}")
def plan_organize_pooled(spark, sf):
    return plan.assign_unique(plan.organised(doc_rows(spark, sf)))


@query(f"with recursive {CATEGORY_SQL}, {PRUNED_SQL}, x as (select *, {EXT_SQL.format(n='name')} as x from pruned), dsts as (select seq, rel as src, coalesce(category, 'Other') || '/' || case when x = '' then 'no-extension' else x end || '/' || rel as dst from x left join dim on dim.ext = x.x) {UNIQUE_SQL}")
def plan_organize_keep_tree(spark, sf):
    return plan.assign_unique(plan.organised(doc_rows(spark, sf), keep_tree=True))


@query("with f as (select doc_id as seq, octet_length(encode(text)) as size from documents), s as (select *, count(*) over (partition by size) as k from f where size > 0) select seq, size from s where k > 1")
def dedup_size_candidates(spark, sf):
    return dedup.by_size(doc_files(spark, sf).select("seq", "size"))


@query(f"with {SETS_SQL.format(head=256)} select seq, size, ph as head_hash from c2")
def dedup_partial_groups(spark, sf):
    return dedup.by_head(doc_files(spark, sf), 256).select("seq", "size", "head_hash")


@query(f"with {SETS_SQL.format(head=65536)} select size, keep, skip from sets")
def dedup_sets(spark, sf):
    return dedup.sets(doc_files(spark, sf))


@query(f"with {SETS_SQL.format(head=256)} select count(*) as sets, cast(coalesce(sum(len(skip)), 0) as bigint) as files, cast(coalesce(sum(len(skip) * size), 0) as bigint) as bytes, (select count(*) from c1) + (select count(*) from c2 where size > 256) as hashed from sets")
def dedup_summary(spark, sf):
    return dedup.summary(doc_files(spark, sf), 256)


@query(f"with {SETS_SQL.format(head=65536)} select doc_id as seq, source as src from documents where doc_id not in (select unnest(skip) from sets)")
def dedup_filtered_plan(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("src"))
    return dedup.resolved(rows, dedup.members(doc_files(spark, sf)), "skip")


@query(f"with {ENTRIES_SQL} select parent, count(*) filter (kind <> 'dir') as files, count(*) filter (kind = 'dir') as dirs from entries where not {META_SQL.format(n='name')} group by parent")
def dir_counts(spark, sf):
    return tree.counts(doc_tree(spark, sf))


@query(f"with {ENTRIES_SQL} select d.rel as path, count(e.rel) as subdirs from dirs d left join (select * from entries where kind = 'dir') e on e.parent = d.rel group by d.rel")
def subdir_counts(spark, sf):
    return tree.subdir_counts(doc_tree(spark, sf))


@query(f"with {ENTRIES_SQL} select count(*) as n from entries where kind = 'dir' and parent = '' and not {META_SQL.format(n='name')}")
def toplevel_subdirs(spark, sf):
    return doc_tree(spark, sf).where((F.col("kind") == "dir") & (F.col("parent") == "") & ~dims.is_metadata(F.col("name"))).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {ENTRIES_SQL}, open(path) as (values {', '.join(f'({p!r})' for p in EXPANDED)}),
seen as (select rel, string_split(rel, '/') as p from dirs where len(list_filter(string_split(rel, '/'), lambda x: {META_SQL.format(n='x')})) = 0),
vis as (select rel, p from seen where len(list_filter({UP_SQL.format(p='p')}, lambda u: not list_contains([{', '.join(repr(p) for p in EXPANDED)}], u))) = 0)
select rel, len(p) - 1 as depth, row_number() over (order by p) - 1 as row_no from vis""")
def tree_preorder(spark, sf):
    shown = tree.visible(doc_tree(spark, sf), spark.createDataFrame([(p,) for p in EXPANDED], "path string"))
    return plan.numbered(shown, paths.parts(F.col("rel")), name="row_no").select("rel", (F.size(paths.parts(F.col("rel"))) - 1).alias("depth"), "row_no")


@query(f"with {ENTRIES_SQL}, own as (select parent, name, rel, row_number() over (partition by parent order by name, rel) as place, count(*) over (partition by parent) as total from entries where kind <> 'dir' and not {META_SQL.format(n='name')}) select parent, place, name, greatest(total - 10, 0) as more from own where place <= 10")
def dir_preview(spark, sf):
    return tree.preview(doc_tree(spark, sf))


@query(f"with {ENTRIES_SQL} select row_number() over (order by lower(name), name) - 1 as place, name from entries where kind = 'dir' and parent = 'en'")
def picker_listing(spark, sf):
    return tree.listing(doc_tree(spark, sf), "en")


@query(f"with {ENTRIES_SQL}, l as (select row_number() over (order by lower(name), name) - 1 as place, name, count(*) over () as n from entries where kind = 'dir' and parent = 'en') select place, name from l where lower(left(name, 1)) = 's' order by ((place - 4) % n + n) % n limit 1")
def picker_jump(spark, sf):
    return tree.jump(tree.listing(doc_tree(spark, sf), "en"), 3, "S")


@query(f"with {MANIFEST_SQL} select doc_id, trim(translate(regexp_replace(name, '\\.[^.]*$', ''), '_-', '  ')) as title from named")
def title_from_name(spark, sf):
    return doc_manifest(spark, sf).select("doc_id", paths.title(paths.name(F.col("rel"))).alias("title"))


@query("""select page_id as id, 'pages' as origin, case when regexp_matches(ltrim(html, chr(9) || chr(10) || chr(12) || chr(13) || ' '), '^(?i:(<(!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P)[ >])|<!--[ >])') then 'text/html; charset=utf-8' else 'text/plain; charset=utf-8' end as mime from pages
union all select doc_id, 'documents', 'text/plain; charset=utf-8' from documents""")
def mime_sniff(spark, sf):
    own = lambda t, i, c: extract.extracted(table(spark, sf, t).select(F.col(i).cast("string").alias("rel"), F.lit(0).cast("long").alias("size"), F.encode(c, "UTF-8").alias("content"))).select(F.col("path").cast("long").alias("id"), F.lit(t).alias("origin"), "mime")
    return own("pages", "page_id", "html").unionByName(own("documents", "doc_id", "text"))


@query(f"with p as ({PAGE_MANIFEST}), n as (select page_id, rel, string_split(rel, '/')[-1] as name from p) select rel as path, trim(translate(regexp_replace(name, '\\.[^.]*$', ''), '_-', '  ')) as title, 'text/html; charset=utf-8' as mime, octet_length(encode(html)) as size from n join pages using (page_id)")
def inspect_rows(spark, sf):
    rows = page_manifest(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return extract.extracted(rows.select("rel", F.octet_length("html").cast("long").alias("size"), F.encode("html", "UTF-8").alias("content"))).select("path", "title", "mime", "size")


@query(f"select l_orderkey, l_linenumber, {HUMAN_SQL.format(n='(l_orderkey * l_partkey * l_linenumber)')} as human from lineitem")
def human_bytes(spark, sf):
    n = F.col("l_orderkey") * F.col("l_partkey") * F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.human_bytes(n).alias("human"))


@query("select l_orderkey, l_linenumber, case when l_extendedprice * 997 - 5e6 <= 0 then '— MB/s' else printf('%.1f', (l_extendedprice * 997 - 5e6) / 1e6) || ' MB/s' end as human from lineitem")
def human_rate(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.human_rate(F.col("l_extendedprice") * 997 - F.lit(5e6)).alias("human"))


@query("""with d as (select o_orderkey, o_orderkey * 7919333 as ns, (o_orderkey * 7919333 + 500000000) // 1000000000 as s from orders)
select o_orderkey, case when ns < 1000000000 then printf('%.1f', ns / 1e9) || 's' when s < 60 then s || 's'
  when s < 3600 then (s // 60) || 'm' || lpad(cast(s % 60 as varchar), 2, '0') || 's' else (s // 3600) || 'h' || lpad(cast((s % 3600) // 60 as varchar), 2, '0') || 'm' end as human from d""")
def human_duration(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.human_duration(F.col("o_orderkey") * 7919333).alias("human"))


@query("select page_id, case when length(url) <= 24 then url else left(url, 11) || '…' || right(url, 12) end as short from pages")
def truncate_middle(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.truncate_middle(F.col("url"), 24).alias("short"))


@query(f"with {LOG_SQL} select job, seq, bytes from log")
def progress_running_bytes(spark, sf):
    return progress_log(spark, sf).select("job", "seq", "bytes")


@query(f"""with recursive {LOG_SQL}, n as (select *, row_number() over (partition by job order by seq) as rn from log),
m(job, rn, seq, last_at, last_bytes, rate, seen, moved) as (
  select distinct job, cast(0 as bigint), cast(null as bigint), cast(0 as bigint), cast(0 as bigint), cast(0.0 as double), cast(0 as bigint), cast(0 as bigint) from n
  union all
  select n.job, n.rn, n.seq,
    case when n.elapsed_ns > last_at and (rate = 0 or n.elapsed_ns - last_at >= {progress.RESAMPLE_NS}) then n.elapsed_ns else last_at end,
    case when n.elapsed_ns > last_at and (rate = 0 or n.elapsed_ns - last_at >= {progress.RESAMPLE_NS}) then n.bytes else last_bytes end,
    case when n.elapsed_ns > last_at and (rate = 0 or n.elapsed_ns - last_at >= {progress.RESAMPLE_NS}) then
      case when rate = 0 then (n.bytes - last_bytes) / ((n.elapsed_ns - last_at) / 1e9) else {progress.KEEP} * rate + (1 - {progress.KEEP}) * ((n.bytes - last_bytes) / ((n.elapsed_ns - last_at) / 1e9)) end else rate end,
    greatest(seen, n.bytes), case when n.bytes > seen then n.elapsed_ns else moved end
  from m join n on n.job = m.job and n.rn = m.rn + 1)
select m.job, m.seq, round(rate, 3) as rate, log.elapsed_ns - moved as stalled_ns from m join log on log.job = m.job and log.seq = m.seq where rn > 0""")
def rate_meter(spark, sf):
    return progress.rates(progress_log(spark, sf)).select("job", "seq", F.round("rate", 3).alias("rate"), "stalled_ns")


@query(f"""with {LOG_SQL}, x as (select *, coalesce(max(bytes) over (partition by job order by seq rows between unbounded preceding and 1 preceding), 0) as before from log),
y as (select *, coalesce(last_value(case when bytes > before then elapsed_ns end ignore nulls) over (partition by job order by seq), 0) as moved from x)
select job, seq, elapsed_ns - moved as stalled_ns, elapsed_ns - moved >= {progress.STALL_NS} as shown from y""")
def stall_clock(spark, sf):
    return progress.stall_clock(progress_log(spark, sf)).select("job", "seq", "stalled_ns", "shown")


@query("""with d as (select l_orderkey, l_linenumber, l_partkey % 50 as done, l_partkey % 50 + l_suppkey % 40 as total, l_orderkey * 1000003 as elapsed from lineitem),
e as (select *, (elapsed // greatest(done, 1)) * (total - done) as eta from d)
select l_orderkey, l_linenumber, case when done >= 3 and total > done and elapsed > 0 and eta >= 1000000000 then eta end as eta_ns from e""")
def eta(spark, sf):
    done = F.col("l_partkey") % 50
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.eta_ns(done, done + F.col("l_suppkey") % 40, F.col("l_orderkey") * 1000003).alias("eta_ns"))


@query("""with d as (select o_orderkey, o_orderkey % 251 as done, 250 as total, cast(o_totalprice * 100 as bigint) as b, o_custkey * 1000000 as ns from orders)
select o_orderkey, done * 100 // total as percent, repeat('█', cast(done * 30 // total as int)) || repeat('░', cast(30 - done * 30 // total as int)) as bar, case when ns > 0 then b / (ns / 1e9) else 0.0 end as rate from d""")
def progress_line_fields(spark, sf):
    o = table(spark, sf, "orders").where("true")
    fields = progress.line_fields(F.col("o_orderkey") % 251, F.lit(250).cast("long"), F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_custkey") * 1000000)
    return o.select("o_orderkey", *fields)


@query("""with p as (select page_id, '/' || string_split(regexp_replace(url, '^https?://', ''), '/')[1] as a, '/' || upper(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')) as b from pages)
select page_id, lower(a) = lower(b) or starts_with(lower(b), lower(a) || '/') or starts_with(lower(a), lower(b) || '/') as same from p""")
def overlap_guard(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    a, b = F.concat(F.lit("/"), F.split(bare, "/")[0]), F.concat(F.lit("/"), F.upper(F.regexp_replace(bare, "[?#].*$", "")))
    return table(spark, sf, "pages").select("page_id", paths.overlaps(a, b).alias("same"))


@query("with l as (select event_type as job, event_id as seq from events) select job, seq, 'announce' as phase, seq as done from l union all select job, seq, 'complete', seq + 1 from l")
def progress_phases(spark, sf):
    return progress.phases(table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("seq")))


@query(f"""with recursive {LOG_SQL}, n as (select *, row_number() over (partition by job order by seq) as rn, lead(seq) over (partition by job order by seq) is null as final from log),
m(job, rn, seq, elapsed_ns, shown, last_at) as (
  select distinct job, cast(0 as bigint), cast(null as bigint), cast(null as bigint), false, cast(null as bigint) from n
  union all
  select n.job, n.rn, n.seq, n.elapsed_ns, n.final or last_at is null or n.elapsed_ns - last_at >= {progress.REDRAW_NS},
    case when n.final or last_at is null or n.elapsed_ns - last_at >= {progress.REDRAW_NS} then n.elapsed_ns else last_at end
  from m join n on n.job = m.job and n.rn = m.rn + 1)
select job, seq, elapsed_ns from m where rn > 0 and shown""")
def frame_throttle(spark, sf):
    return progress.drawn(progress_log(spark, sf))


def shared_folder(spark: SparkSession) -> Path:
    """A new folder that all executors reach by its path: in the cluster's folder for checkpoints."""
    there = store.folder(spark)
    at = urlparse(there)
    if at.scheme not in ("", "file"):
        raise ValueError(f"files can't be copied in {there}")
    return Path(unquote(at.path) if at.scheme else there) / f"copy-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> None:
    """files (rel, content) as files in folder."""

    def written(rows: Iterator[Row]) -> None:
        for r in rows:
            path = os.path.join(folder, r.rel)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r.content)

    files.select("rel", "content").foreachPartition(written)


@query(ORACLES["plan_flatten"].replace("select seq, src, dst from grown where rn > 0", """select g.seq, g.dst, case when g.seq = 7 then 0 else octet_length(encode(coalesce(p.text, ''))) end as bytes,
  case when g.seq = 7 then 'FileNotFoundError' end as error_class from grown g join pruned p on p.rel = g.src where g.rn > 0"""))
def copy_report(spark, sf):
    """Writes the planned documents as files, all but that of seq 7, and copies all of plan_flatten's rows. The report is stored, the files go."""
    folder = shared_folder(spark)
    try:
        planned = plan_flatten(spark, sf)
        planned.write.parquet((folder / "plan").as_uri())
        planned = spark.read.parquet((folder / "plan").as_uri())
        missing = planned.where("seq = 7").select(F.col("src").alias("rel"))
        files = plan.pruned(doc_manifest(spark, sf)).select("rel", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
        write_files(files.join(F.broadcast(missing), "rel", "left_anti"), str(folder / "in"))
        source = F.concat(F.lit(str(folder / "in") + "/"), "src")
        report = copy.copied(planned.select("seq", source.alias("src"), "dst"), str(folder / "out")).select("seq", "dst", "bytes", "error_class")
        report.write.parquet((folder.parent / f"{folder.name}-report").as_uri())
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return spark.read.parquet((folder.parent / f"{folder.name}-report").as_uri())
