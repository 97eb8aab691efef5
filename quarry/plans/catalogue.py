"""The queries the driver runs, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import describe, scalars
from quarry.operators import extract, fulltext, graph, ledger, search, stale
from quarry.plans import code_queries
from quarry.plans import relations as R
from quarry.sources import git, mapfile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(code_queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(code_queries.ORACLE_SQL)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_RATIO = "case when ext in ('md', 'txt', 'rst', 'adoc') then 4.0 when ext in ('json', 'yaml', 'yml', 'toml', 'xml') then 3.75 else 3.5 end"
_TOKENS = f"ceil(strlen(text)::double / ({_RATIO})::double)::bigint"
_LANGUAGE = "case ext when 'md' then 'Markdown' when 'json' then 'JSON' when 'rs' then 'Rust' when 'py' then 'Python' else ext end"
_tokens = lambda: scalars.estimate_tokens(F.col("text"), F.col("ext"))
_add("token_estimate_per_file", lambda s, d: R.files(s, d).select("path", _tokens().alias("tokens"), scalars.language(F.col("ext")).alias("language")), f"select path, {_TOKENS} as tokens, {_LANGUAGE} as language from {R.FILES}")
_add("token_estimate_by_lang", lambda s, d: R.files(s, d).groupBy("lang").agg(F.sum(_tokens()).alias("tokens"), F.count("*").alias("files")), f"select lang, sum({_TOKENS})::bigint as tokens, count(*) as files from {R.FILES} group by lang")
_add("density_label_boundaries", lambda s, d: R.files(s, d).select("path", scalars.density_label((F.col("n_chars") % 100) / 100.0).alias("label")), f"select path, case when (n_chars % 100) / 100.0 < 0.15 then 'repetitive' when (n_chars % 100) / 100.0 >= 0.5 then 'dense' end as label from {R.FILES}")
_add("lang_distribution_topk", lambda s, d: graph.languages(F.col("ext"), R.files(s, d)), f"select language, files, round(100.0 * files / sum(files) over ())::double as percent from (select {_LANGUAGE} as language, count(*) as files from {R.FILES} group by 1) order by files desc, language limit 4")
_add("lang_distribution_by_extension", lambda s, d: graph.languages(F.col("ext"), R.files(s, d), by_extension=True), f"select ext as language, files, round(100.0 * files / sum(files) over ())::double as percent from (select ext, count(*) as files from {R.FILES} group by 1) order by files desc, ext limit 4")
_add("dir_hotspots_topk", lambda s, d: graph.hotspots(R.imports(s, d).withColumn("target_path", F.concat("target_path", F.lit("/mod.rs")))), f"select target_path as directory, count(*) as imports_in from {R.IMPORTS} group by 1 order by 2 desc, 1 limit 3")

_SEMI = f"select distinct i.imported_name, i.target_path, i.source_file, i.line_number from {R.IMPORTS} i where exists (select 1 from {R.SYMBOLS} s where s.name = i.imported_name and s.file_path = i.target_path)"
_add("importers_of_symbol", lambda s, d: graph.importers(R.imports(s, d), R.symbols(s, d)), _SEMI)
_add("callers_grouped", lambda s, d: graph.callers(R.imports(s, d)), f"select imported_name, source_file, array_to_string(list_sort(list(line_number)), ',') as lines from {R.IMPORTS} group by 1, 2")
_FAN = f"select imported_name, target_path, count(distinct source_file) as importer_files, count(distinct (source_file, line_number)) as importer_sites from {R.IMPORTS} group by 1, 2"
_add("fan_in", lambda s, d: graph.fan_in(R.imports(s, d)), _FAN)
_OVERLAP = f"select distinct s.* from {R.SYMBOLS} s join {R.HUNKS} h on s.file_path = h.file_path and s.line_start <= h.hi and s.line_end >= h.lo"
_add("impact_overlap", lambda s, d: graph.overlapping(R.symbols(s, d), R.hunks(s, d)), _OVERLAP)
_COUNT = "case when o.exported then coalesce(f.importer_sites, 0) else 0 end"
_add("impact_risk", lambda s, d: graph.impact(R.symbols(s, d), R.hunks(s, d), R.imports(s, d)), f"select o.name, o.file_path, o.kind, o.line_start, o.exported, {_COUNT} as importer_count, case when {_COUNT} >= 10 then 'CRITICAL' when {_COUNT} >= 5 then 'HIGH' when {_COUNT} >= 2 then 'MEDIUM' else 'LOW' end as risk from ({_OVERLAP}) o left join ({_FAN}) f on f.imported_name = o.name and f.target_path = o.file_path")
_add("impact_ranked", lambda s, d: graph.most_imported(graph.impact(R.symbols(s, d), R.hunks(s, d), R.imports(s, d)), 30), ORACLE_SQL["impact_risk"] + " order by importer_count desc, file_path, line_start, name limit 30")
_add("affected_files", lambda s, d: graph.affected_files(R.symbols(s, d), R.hunks(s, d), R.imports(s, d)), f"select distinct i.source_file from {R.IMPORTS} i where exists (select 1 from ({_OVERLAP}) o where o.exported and o.name = i.imported_name and o.file_path = i.target_path)")

_qualified = lambda s, d: R.symbols(s, d).withColumn("name", F.when(F.col("exported"), F.concat("kind", F.lit("::NEW"))).otherwise("new"))
_QUALIFIED = f"(select * replace (case when exported then kind || '::NEW' else 'new' end as name) from {R.SYMBOLS})"
_add("sketch_lookup", lambda s, d: search.sketch(_qualified(s, d), "new"), f"select * from {_QUALIFIED} where name = 'new' or lower(name) like '%::new'")
_indexes: dict[tuple, str] = {}


def _find_bm25(s: SparkSession, d: str) -> DataFrame:
    """By the index of the texts, which is written when they are first asked for or have changed since."""
    docs = R.table(s, d, "documents")
    stamp = (d, docs.agg(F.max("_metadata.file_modification_time")).first()[0], id(s))
    if stamp not in _indexes:
        _indexes[stamp] = code_queries.folder(s)
        fulltext.build(docs, "doc_id", _indexes[stamp], ("text",), search.plain_words)
    found = fulltext.match_indexed(s, _indexes[stamp], "the OR est", 20, ("text",))
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_WORDS = "[x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> '']"
_add("find_bm25", _find_bm25, f"""
with w as (select doc_id, {_WORDS} as w from documents), c as (select doc_id, len(w) as n, len([x for x in w if x = 'the']) as t0, len([x for x in w if x = 'est']) as t1 from w),
s as (select count(*) as docs, avg(n) as mean, count(*) filter (t0 > 0) as n0, count(*) filter (t1 > 0) as n1 from c)
select doc_id, round(greatest(ln((docs - n0 + 0.5) / (n0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(ln((docs - n1 + 0.5) / (n1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)), 6) as score
from c, s where t0 > 0 or t1 > 0 order by greatest(ln((docs - n0 + 0.5) / (n0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(ln((docs - n1 + 0.5) / (n1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) desc, doc_id limit 20""")
_add("find_bm25_scan", lambda s, d: search.bm25(R.table(s, d, "documents"), ["the", "est"], match_all=False).select("doc_id", F.round("score", 6).alias("score")), ORACLE_SQL["find_bm25"])
_LIKE = f"select * from {R.SYMBOLS} where lower(name) like '%1%' or lower(signature) like '%1%' order by exported desc, name, file_path, line_start limit 60"
_add("find_like_fallback", lambda s, d: search.like(R.symbols(s, d), "1", 20), _LIKE)
_WEIGHT = "case when p.kind in ('fn', 'method', 'struct', 'enum', 'trait', 'class', 'type', 'interface') then 2 when p.kind in ('const', 'static', 'var', 'let') then 1 else 0 end"

def _reranked(s: SparkSession, d: str) -> DataFrame:
    pool = search.with_position(search.like(R.symbols(s, d), "1", 20), F.desc("exported"), "name", "file_path", "line_start")
    return search.rerank(pool, R.imports(s, d), 20).select("name", "file_path", "kind", "exported", "importer_files", "position")


_add("find_reranked", _reranked, f"select p.name, p.file_path, p.kind, p.exported, coalesce(f.importer_files, 0) as importer_files, p.position::int as position from (select *, row_number() over (order by exported desc, name, file_path, line_start) - 1 as position from ({_LIKE})) p left join ({_FAN}) f on f.imported_name = p.name and f.target_path = p.file_path order by coalesce(f.importer_files, 0) desc, p.exported desc, {_WEIGHT} desc, p.position limit 20")

_CHANGE = f"(select coalesce(c.path, s.path) as path, case when s.path is null then 'added' when c.path is null then 'removed' when (case when c.content_hash is not null and s.content_hash is not null then c.content_hash <> s.content_hash else c.description is distinct from s.description or c.token_estimate is distinct from s.token_estimate end) then 'modified' end as change from {R.CURRENT} c full join {R.STORED} s on c.path = s.path)"
_both = lambda s, d: (R.snapshot(s, d, False), R.snapshot(s, d, True))
_add("snapshot_differences", lambda s, d: stale.differences(*_both(s, d)), f"select * from {_CHANGE} where change is not null")
_N = {k: f"count(*) filter (change = '{k}')" for k in ("added", "removed", "modified")}
_add("staleness_report", lambda s, d: stale.staleness(*_both(s, d)), f"select added, removed, modified, case when added + removed + modified = 0 then 'up to date' else concat_ws(', ', case when added > 0 then added || ' added' end, case when removed > 0 then removed || ' removed' end, case when modified > 0 then modified || ' modified' end) end as report from (select {', '.join(f'{v} as {k}' for k, v in _N.items())} from {_CHANGE})")
_add("mtime_drift", lambda s, d: stale.mtime_drift(*_both(s, d)), f'select coalesce(c.path, s.path) as path, c.mtime_ms as "now", s.mtime_ms as "before" from {R.CURRENT} c full join {R.STORED} s on c.path = s.path where c.mtime_ms is distinct from s.mtime_ms')
_add("upsert_files", lambda s, d: stale.upsert(R.snapshot(s, d, True), R.snapshot(s, d, False)), f"select * from {R.CURRENT} union all select * from {R.STORED} s where not exists (select 1 from {R.CURRENT} c where c.path = s.path)")
_add("delete_files", lambda s, d: stale.delete(R.snapshot(s, d, True), R.snapshot(s, d, False).select("path")), f"select * from {R.STORED} s where not exists (select 1 from {R.CURRENT} c where c.path = s.path)")
_add("enrich_metadata", lambda s, d: stale.enrich(*_both(s, d)), f"select c.path, c.description, c.token_estimate, coalesce(s.content_hash, c.content_hash) as content_hash, coalesce(s.mtime_ms, c.mtime_ms) as mtime_ms from {R.CURRENT} c left join {R.STORED} s on c.path = s.path")

_SAVED = "coalesce(sum(case when event_kind not in ('session_start', 'first_edit', 'first_edit_turns', 'arch_hit') then token_impact end), 0)::bigint"
_K = {k: f"count(*) filter (event_kind = '{k}')" for k in ledger.KINDS}
_rate = lambda n: f"coalesce({_K[n + '_hit']} * 100.0::double / nullif({_K[n + '_hit']} + {_K[n + '_miss']}, 0), 0.0)::double as {n}_rate"
_GAIN = f"count(*) as total_events, {', '.join(f'{v} as n_{k}' for k, v in _K.items())}, {_rate('map')}, {_rate('sketch')}, {_rate('arch')}, {_SAVED} as tokens_saved, coalesce(avg(case when event_kind = 'first_edit' then token_impact end), 0.0) as avg_first_edit, coalesce(avg(case when event_kind = 'first_edit_turns' then token_impact end), 0.0) as avg_first_edit_turns"
_add("gain_summary", lambda s, d: ledger.gain(R.events(s, d)), f"select {_GAIN} from {R.EVENTS}")
_add("gain_by_project", lambda s, d: ledger.gain(R.events(s, d), ("project_path",)), f"select project_path, {_GAIN} from {R.EVENTS} group by project_path")
_add("gain_daily", lambda s, d: ledger.daily(R.events(s, d)), f"select ts::date as day, count(*) as events, {_SAVED} as tokens_saved from {R.EVENTS} group by 1 order by 1 desc limit 30")
_add("retention_purge", lambda s, d: ledger.retained(R.events(s, d), F.lit("2024-01-20").cast("timestamp_ntz")), f"select * from {R.EVENTS} where ts >= timestamp '2024-01-20'")
_add("first_edit_sessions", lambda s, d: ledger.first_edits(R.events(s, d)), f"with p as (select * from (select *, max(case when event_kind = 'session_start' then ts end) over (partition by project_path order by ts, id rows unbounded preceding) as session_start from {R.EVENTS}) where session_start is not null), e as (select project_path, session_start, min(ts) as first_edit from p where event_kind = 'first_edit' group by 1, 2) select e.project_path, e.session_start, e.first_edit, count(p.ts) as turns from e left join p on p.project_path = e.project_path and p.session_start = e.session_start and p.ts > e.session_start and p.ts < e.first_edit group by 1, 2, 3")

_PRICE = "(o_totalprice * 7)::decimal(18,2)::bigint"
_add("format_tokens", lambda s, d: R.table(s, d, "orders").select("o_orderkey", scalars.format_tokens(F.col("o_orderkey") * 37).alias("text")), "select o_orderkey, case when abs(n) >= 999950 then printf('%.1f', n / 1e6) || 'M' when abs(n) >= 1000 then printf('%.1f', n / 1e3) || 'K' else n::varchar end as text from (select o_orderkey, o_orderkey * 37 as n from orders)")
_add("format_duration", lambda s, d: R.table(s, d, "orders").select("o_orderkey", scalars.format_duration(F.col("o_custkey").cast("double")).alias("text")), "select o_orderkey, case when o_custkey < 60 then o_custkey || 's' else (o_custkey // 60) || 'm' || case when o_custkey % 60 = 0 then '' else ' ' || (o_custkey % 60) || 's' end end as text from orders")
_add("bar_and_rate", lambda s, d: R.table(s, d, "orders").select("o_orderkey", scalars.bar((F.col("o_orderkey") % 140 - 20) / 100.0).alias("bar"), scalars.rate_color(F.col("o_orderkey") % 100).alias("color")), "select o_orderkey, repeat('█', n) || repeat('░', 10 - n) as bar, case when o_orderkey % 100 >= 75 then 'green' when o_orderkey % 100 >= 50 then 'yellow' else 'red' end as color from (select o_orderkey, round(greatest(least((o_orderkey % 140 - 20) / 100.0, 1.0), 0.0) * 10)::int as n from orders)")
_HEADER = "'@@ -' || l_partkey || ',' || (l_linenumber % 3) || ' +' || l_suppkey || ',' || (l_linenumber % 2) || ' @@'"
_header = lambda: F.concat(F.lit("@@ -"), F.col("l_partkey").cast("string"), F.lit(","), (F.col("l_linenumber") % 3).cast("string"), F.lit(" +"), F.col("l_suppkey").cast("string"), F.lit(","), (F.col("l_linenumber") % 2).cast("string"), F.lit(" @@"))
_add("hunk_header_parse", lambda s, d: R.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.hunk_range(_header()).alias("r")).select("l_orderkey", "l_linenumber", F.col("r.start").alias("lo"), F.col("r.end").alias("hi")), "select l_orderkey, l_linenumber, case when l_linenumber % 2 > 0 then l_suppkey when l_linenumber % 3 > 0 then l_partkey end as lo, case when l_linenumber % 2 > 0 then l_suppkey when l_linenumber % 3 > 0 then l_partkey + l_linenumber % 3 - 1 end as hi from lineitem")
_add("html_title", lambda s, d: R.table(s, d, "pages").select("page_id", describe.html_title(F.col("html")).alias("title")), "select page_id, case when regexp_matches(html, '<title>([^<]+)</title>') then trim(regexp_extract(html, '<title>([^<]+)</title>', 1)) else 'HTML document' end as title from pages")
_add("project_longest_prefix", lambda s, d: graph.owning_root(R.files(s, d).select("path"), R.files(s, d).select(F.regexp_extract("path", "^(.*)/", 1).alias("root")).union(R.files(s, d).select(F.col("lang").alias("root"))).filter(~F.endswith("root", F.lit("3"))).distinct()), f"select path, case when regexp_extract(path, '^(.*)/', 1) like '%3' then regexp_extract(path, '^([^/]*)/', 1) else regexp_extract(path, '^(.*)/', 1) end as root from {R.FILES}")

_name = lambda: F.regexp_extract("path", "([^/]*)$", 1)
_add("describe_files", lambda s, d: R.files(s, d).select("path", describe.describe(_name(), F.col("ext"), F.col("text")).alias("description")), f"select path, case ext when 'md' then case when regexp_matches(text, '(^|\\n)# ') then trim(regexp_extract(text, '(^|\\n)# ([^\\n]*)', 2)) else 'markdown document' end when 'json' then 'JSON data' else ext || ' source file' end as description from {R.FILES}")
_add("gzip_density", lambda s, d: R.files(s, d).select("path", extract.gzip_density("text").alias("density")))
_add("map_lines", lambda s, d: mapfile.lines(R.files(s, d).select("path", F.col("lang").alias("description"), F.col("n_chars").alias("token_estimate"), ((F.col("n_chars") % 100) / 100.0).alias("density"))), f"select regexp_extract(path, '^(.*)/', 1) as folder, path, '- `' || regexp_extract(path, '([^/]*)$', 1) || '` — ' || lang || ' (~' || n_chars || ' tok' || case when (n_chars % 100) / 100.0 < 0.15 then ', repetitive' when (n_chars % 100) / 100.0 >= 0.5 then ', dense' else '' end || ')' as line from {R.FILES}")
_tail = lambda: F.concat(F.lit(" — "), F.col("o_orderpriority"), F.lit(" (~"), F.col("o_orderkey").cast("string"), F.lit(" tok"), F.when(F.col("o_orderkey") % 3 == 0, ", dense").when(F.col("o_orderkey") % 3 == 1, ", repetitive").otherwise(""), F.lit(")"))
_add("map_tail_parse", lambda s, d: R.table(s, d, "orders").select("o_orderkey", mapfile.entry_tail(_tail()).alias("e")).select("o_orderkey", "e.*"), "select o_orderkey, o_orderpriority as description, o_orderkey as token_estimate, case o_orderkey % 3 when 0 then 0.55::double when 1 then 0.1::double end as density from orders")
_key = lambda: F.col("s_suppkey").cast("string")
_diff = lambda: F.concat(F.lit("--- a/f"), _key(), F.lit("\n+++ b/"), F.when(F.col("s_suppkey") % 2 == 0, "g").otherwise("f"), _key(), F.lit("\n@@ -5,2 +"), _key(), F.lit(",3 @@\n--- a/gone"), _key(), F.lit("\n+++ /dev/null\n@@ -1,"), _key(), F.lit(" +0,0 @@\n"))
_add("diff_hunks", lambda s, d: git.hunks(R.table(s, d, "supplier").select("s_suppkey", _diff().alias("diff")), keep=("s_suppkey",)), """
select s_suppkey, case when s_suppkey % 2 = 0 then 'g' else 'f' end || s_suppkey as file_path, s_suppkey as "start", s_suppkey + 2 as "end" from supplier
union all select s_suppkey, 'f' || s_suppkey, 5, 6 from supplier where s_suppkey % 2 = 0
union all select s_suppkey, 'gone' || s_suppkey, 1, s_suppkey from supplier where s_suppkey > 0""")
_add("find_fulltext", lambda s, d: fulltext.match(R.symbols(s, d), 'signature:"large widget" OR kind:struct', ("name",), None).select("name", F.round("score", 6).alias("score")), f"""
with c as (select name, 3 + len(string_split(signature, ' ')) as n, (signature = 'large widget')::int as t0, (kind = 'struct')::int as t1 from {R.SYMBOLS}),
s as (select count(*) as docs, avg(n) as mean, sum(t0) as n0, sum(t1) as n1 from c),
i as (select mean, greatest(ln((docs - n0 + 0.5) / (n0 + 0.5)), 1e-6) as i0, greatest(ln((docs - n1 + 0.5) / (n1 + 0.5)), 1e-6) as i1 from s)
select name, round((i0 * t0 + i1 * t1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / mean)), 6) as score from c, i where t0 + t1 > 0""")
