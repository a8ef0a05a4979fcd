"""Extraction: files of every format, made of the tables, cut into units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memloom.session import table
from memloom.sources.chunkers import FORMATS, classified, extract_units


def _files(rows: DataFrame, policy: str = "mirror") -> DataFrame:
    """``rows`` (path, text) as files."""
    return rows.select("path", F.lit(policy).alias("policy"), F.col("text").cast("binary").alias("content"))


def _short(units: DataFrame) -> DataFrame:
    return units.select("id", "kind", "category", "qualname", "lineno", "line_end", "lang", "content_sha")


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of markdown, underlined titles, plain text or log lines, by its id; saved sessions among them are read as such."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "rst", "txt", "log"))), (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("d/"), "doc_id", F.lit("."), ext).alias("path"), "text")
    return _short(extract_units(_files(rows)))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message once."""
    once = table(spark, sf_dir, "chat_messages").where("message_id is not null and conv_id is not null").groupBy("message_id").agg(F.min(F.struct("received_at", "conv_id", "seq", "role", "content")).alias("m"))
    return once.select("message_id", "m.*")


def _in_order(value: Column, by: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(by), value.alias("v")))), lambda x: x["v"]), "\n")


def session_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session as it is saved: a head, then the turns behind their marks."""
    mark = F.when(F.lower(F.trim("role")).startswith("a"), "=== Assistant ===").otherwise("=== Human ===")
    said = F.concat(mark, F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = _messages(spark, sf_dir).groupBy("conv_id").agg(_in_order(said, "message_id").alias("all"))
    rows = rows.select(F.concat(F.lit("s/"), "conv_id", F.lit(".md")).alias("path"), F.concat(F.lit("---\ntitle: saved\n---\n"), "all").alias("text"))
    return _short(extract_units(_files(rows)))


def _quoted(value: Column) -> Column:
    """A string as JSON; null stays null."""
    return F.expr(f"case when {value} is not null then substring(to_json(named_struct('x', {value})), 6, length(to_json(named_struct('x', {value}))) - 6) end")


def chat_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session as another program exports it: objects with role, thread and a text or a list of blocks."""
    content = F.when(F.col("content").startswith("[{"), F.col("content")).otherwise(_quoted("content"))
    role = F.coalesce(_quoted("role"), F.lit("null"))
    message = F.concat(F.lit('{"id": '), "message_id", F.lit(', "role": '), role, F.lit(', "thread_id": '), _quoted("conv_id"), F.lit(', "content": '), F.coalesce(content, F.lit("null")), F.lit("}"))
    rows = _messages(spark, sf_dir).groupBy("conv_id").agg(_in_order(message, "message_id").alias("all"))
    rows = rows.select(F.concat(F.lit("c/"), "conv_id", F.lit(".jsonl")).alias("path"), F.col("all").alias("text"))
    return extract_units(_files(rows)).where("lang = 'chat'").select("id", "kind", "lineno", "content_sha", "follows")


def ndjson_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as lines of JSON, with a line in seven broken and a name that repeats."""
    line = F.when(F.col("event_id") % 7 == 0, "{broken").when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"n": '), "event_id", F.lit(', "id": "'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('{"n":'), "event_id", F.lit("}")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(_in_order(line, "event_id").alias("text")).select(F.concat(F.lit("e/"), "user_id", F.lit(".ndjson")).alias("path"), "text")
    return extract_units(_files(rows)).select("id", "kind", "lineno", "text")


def sheet_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as a table of comma- or tab-separated values."""
    mark = F.when(F.col("c_nationkey") % 2 == 0, ",").otherwise("\t")
    line = F.concat("c_name", mark, F.col("c_custkey").cast("string"), mark, "c_mktsegment")
    rows = table(spark, sf_dir, "customer").withColumn("m", mark).groupBy("c_nationkey", "m").agg(_in_order(line, "c_custkey").alias("all"))
    path = F.concat(F.lit("t/n"), "c_nationkey", F.when(F.col("m") == ",", ".csv").otherwise(".tsv"))
    rows = rows.select(path.alias("path"), F.concat(F.lit("name"), "m", F.lit("key"), "m", F.lit("segment\n"), "all").alias("text"))
    return extract_units(_files(rows)).select("id", "kind", "lineno", "text")


def json_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as nested data: a flat entry that stays whole and a large one that is split by its key paths."""
    entry = F.concat(F.lit('"'), "c_custkey", F.lit('": {"name": "'), "c_name", F.lit('", "segment": "'), "c_mktsegment", F.lit('"}'))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(entry)), ", ").alias("all"))
    rows = rows.select(F.concat(F.lit("j/n"), "c_nationkey", F.lit(".json")).alias("path"), F.concat(F.lit('{"flat": {"nation": '), "c_nationkey", F.lit('}, "deep": {'), "all", F.lit(', "more": []}}')).alias("text"))
    return extract_units(_files(rows)).select("id", "kind", "lineno", "text")


_PY = "import os.path as p\nfrom util import helper as h\n\nclass C{0}(Base, p.Other):\n    def m(self):\n        return h(self.n())\n\n    @property\n    def x(self):\n        return 1\n\n    @x.setter\n    def x(self, v):\n        set(v)\n\nif p:\n    def f{0}():\n        def inner():\n            g()\n        p.join(inner())\n"


def python_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for every nation, with a class, a property set in two places, a function below a condition and one within it; and one that is no Python."""
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"))
    before, *between = _PY.split("{0}")
    text = F.concat(F.lit(before), *[x for part in between for x in (F.col("n"), F.lit(part))])
    rows = keys.select(F.concat(F.lit("p/m"), "n", F.lit(".py")).alias("path"), F.when(F.col("n") == "7", "def (").otherwise(text).alias("text"))
    flat = lambda c: F.array_join(c, ",")
    return extract_units(_files(rows)).select("id", "kind", "lineno", "line_end", flat("calls").alias("calls"), flat("bases").alias("bases"), flat("defines").alias("defines"), flat("imports").alias("imports"), flat(F.array_sort(F.map_values("import_bindings"))).alias("bound"))


OVERRIDE = {"code/plan.py": ("doc", "text")}


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, language and whether that is a guess for every source path, and for the same with odd extensions, overrides and binary contents."""
    paths = table(spark, sf_dir, "units").where("source_path is not null").select(F.col("source_path").alias("path")).distinct()
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    odd = paths.select(F.explode(F.array(F.concat(stem, F.lit(".odd")), stem, F.concat(stem, F.lit(".TSV")), F.concat(stem, F.lit(".rs")))).alias("path"))
    every = paths.unionByName(odd).unionByName(spark.createDataFrame([(p,) for p in OVERRIDE], "path string")).distinct()
    content = F.when(F.length("path") % 5 == 0, F.lit("a\0b")).otherwise(F.lit("ab"))
    return classified(_files(every.withColumn("text", content)), OVERRIDE).select("path", "category", "lang", "ambiguous")


QUERIES = {f.__name__: f for f in (document_units, session_units, chat_units, ndjson_units, sheet_units, json_units, python_units, classify_files)}

_B = r"[ \t\r\n\f\x0B]"
_STRIP = "regexp_replace({0}, '^" + _B + "+|" + _B + "+$', '', 'g')"
#: From fl (path, ext, t): lines, with a line end at the end of a text beginning no further line.
_LN = r"""
ln as (select path, ext, unnest(xs) line, unnest(range(1, len(xs) + 1)) no from (select path, ext, string_split(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) xs from fl))"""
_JOIN = _STRIP.format("string_agg(line, chr(10) order by no)")
_TURN = r"'^=== (Human|Assistant) ===\s*$'"
_SESSION = rf"""
tn as (select *, count(*) filter (regexp_matches(line, {_TURN})) over (partition by path order by no) k from ln where ext = 'session'),
p_session as (select path, 'section' kind, 'm' || k name, min(no) a, max(no) b, {_JOIN} x, 'session' lang from tn where k > 0 group by path, k)"""


def _parts(name: str, letter: str, rows: str, kind: str, lang: str) -> str:
    return f"""{name} as (select path, '{kind}' kind, '{letter}' || row_number() over (partition by path order by a) name, a, b, x, '{lang}' lang from (select path, min(no) a, max(no) b, {_JOIN} x from ({rows}) group by path, g) where x <> '')"""


def _sections(name: str, ext: str, heads: str, lang: str) -> str:
    slug = r"substr(regexp_replace(regexp_replace(lower(ti), '[^\p{L}\p{N}_\- \t]', '', 'g'), '[ \t-]+', '-', 'g'), 1, 60)"
    return f"""{name}_n as (select ln.path, ln.no, line, ti, count(ti) over (partition by ln.path order by ln.no) g from ln left join {heads} h on h.path = ln.path and h.no = ln.no where ext = '{ext}'),
{name}_g as (select path, g, min(no) a, max(no) b, max(ti) ti, {_JOIN} x from {name}_n group by path, g),
{name}_s as (select *, case when g = 0 then '_preamble' when {slug} = '' then 'section' else {slug} end base from (select path, g, a, b, x, {_STRIP.format("ti")} ti from {name}_g where x <> '')),
{name} as (select path, 'section' kind, case when n > 1 then base || '-' || (n - 1) else base end name, a, b, x, '{lang}' lang from (select *, row_number() over (partition by path, base order by a) n from {name}_s))"""


_MARK = "(" + "|".join(f"[{c}]{{3,}}" if c != "^" else r"\^{3,}" for c in ["=", r"\-", "~", "^", '"', "#", "*", "+", ".", ":", "''", "`", "_"]) + ")"
_ADORN = rf"'^{_MARK}\s*$'"
_TIME = r"'^\s*\[?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})'"

_KNOWN = ", ".join(f"('{k}', '{c}', '{g}')" for k, (c, _, g) in FORMATS.items())

SQL = {
    "document_units": rf"""with recursive fx as (select 'd/' || doc_id || '.' || ['md', 'rst', 'txt', 'log'][doc_id % 4 + 1] path, ['md', 'rst', 'txt', 'log'][doc_id % 4 + 1] ext, text t from documents where text is not null and not contains(substr(text, 1, 2048), chr(0))),
fl as (select path, case when ext in ('md', 'txt') and regexp_matches(regexp_replace(substr(t, 1, 4096), '\r\n?', chr(10), 'g'), '(?m)' || {_TURN}) then 'session' else ext end ext, t from fx),{_LN},
{_SESSION}, lg as (select distinct path from ln where ext = 'log' and regexp_matches(line, {_TIME})),
{_parts("p_log", "e", "select path, no, line, (no - 1) // 50 g from ln where path in (from lg)", "block", "log")},
{_parts("p_txt", "b", f"select path, no, line, no - row_number() over (partition by path order by no) g from ln where (ext = 'txt' or ext = 'log' and path not in (from lg)) and regexp_matches(line, '[^ ' || chr(9) || chr(12) || chr(11) || ']')", "block", "text")},
fm as (select path, no, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) m, row_number() over (partition by path order by no) k from ln where ext = 'md' and regexp_matches(line, '^ {{0,3}}(`{{3,}}|~{{3,}})')),
fs(path, k, no, o) as (select path, k, no, m from fm where k = 1 union all select fm.path, fm.k, fm.no, case when fs.o = '' then fm.m when fm.m[1] = fs.o[1] and len(fm.m) >= len(fs.o) then '' else fs.o end from fs join fm on fm.path = fs.path and fm.k = fs.k + 1),
hm as (select ln.path, ln.no, regexp_extract(line, '^(#{{1,6}})\s+(.*)$', 2) ti from ln where ext = 'md' and regexp_matches(line, '^(#{{1,6}})\s+(.*)$')
  and coalesce((select arg_max(o, fs.no) from fs where fs.path = ln.path and fs.no < ln.no), '') = ''),
{_sections("p_md", "md", "hm", "markdown")},
ad as (select path, no, line, regexp_replace(line, '{_B}+$', '') b0, coalesce(lead(regexp_replace(line, '{_B}+$', '')) over w, '') b1, coalesce(lead(regexp_replace(line, '{_B}+$', ''), 2) over w, '') b2 from ln where ext = 'rst' window w as (partition by path order by no)),
bt as (select *, regexp_matches(b0, {_ADORN}) and regexp_matches(b1, '[^ \t\f\x0B]') and regexp_matches(b2, {_ADORN}) and b0[1] = b2[1] bw, regexp_matches(b0, '[^ \t\f\x0B]') and regexp_matches(b1, {_ADORN}) and length(b1) >= length({_STRIP.format("b0")}) un from ad),
ht as (select path, no, case when bw then b1 else b0 end ti from (select *, coalesce(lag(bw) over w, false) or coalesce(lag(bw, 2) over w, false) ins, coalesce(lag(un) over w, false) aft from bt window w as (partition by path order by no)) where not ins and (bw or un and not aft)),
rn as (select ln.* from ln where ext = 'rst' and path in (select path from ht)),
{_sections("p_rst_", "rst", "ht", "rst")}, p_rst as (select * from p_rst_ where path in (select path from ht)),
al as (select * from p_session union all select * from p_log union all select * from p_txt union all select * from p_md union all select * from p_rst)
select 'doc:' || fl.path || case when al.kind is null then '' else '::' || name end id, coalesce(al.kind, 'file') kind, 'doc' category, coalesce(name, '') qualname, cast(coalesce(a, 1) as integer) lineno,
 cast(coalesce(b, (select max(no) from ln where ln.path = fl.path)) as integer) line_end, coalesce(lang, case ext when 'md' then 'markdown' when 'txt' then 'text' else ext end) lang, sha256(coalesce(x, t)) content_sha from fl left join al on al.path = fl.path""",
    "session_units": rf"""with o as (select message_id, arg_min(struct_pack(conv_id, role, content), received_at) r from chat_messages where message_id is not null and conv_id is not null group by 1),
fl as (select 's/' || r.conv_id || '.md' path, 'session' ext, '---' || chr(10) || 'title: saved' || chr(10) || '---' || chr(10) || string_agg(case when lower(trim(r.role)) like 'a%' then '=== Assistant ===' else '=== Human ===' end || chr(10) || coalesce(r.content, ''), chr(10) order by message_id) t from o group by r.conv_id),{_LN},
{_SESSION} select 'doc:' || path || '::' || name id, kind, 'doc' category, name qualname, cast(a as integer) lineno, cast(b as integer) line_end, lang, sha256(x) content_sha from p_session""",
    "chat_units": rf"""with o as (select message_id, arg_min(struct_pack(conv_id, role, content), received_at) r from chat_messages where message_id is not null and conv_id is not null group by 1),
m as (select message_id, r.conv_id conv, case when r.role = '' then null else r.role end who, r.content c, case when r.content like '[{{%' then cast(r.content as json[]) end bl from o),
b as (select *, list_transform(bl, lambda e, i: coalesce(nullif(coalesce(e->>'$.text', ''), ''), e->>'$.content', '== Attachment ' || len(list_filter(bl[1:i], lambda q: coalesce(q->>'$.text', '') = '' and q->>'$.content' is null)) || ': ' || coalesce(e->>'$.type', 'attachment') || ' ==')) ts from m),
k as (select conv from m group by conv having count(*) > 1 and count(who) >= 0.6 * count(*) and count(*) filter (c <> '') >= 0.6 * count(*)),
u as (select 'doc:c/' || conv || '.jsonl::' || message_id id, conv, message_id, {_STRIP.format("'[' || coalesce(who, 'unknown') || '] (thread ' || conv || ')' || chr(10) || case when bl is not null then array_to_string(list_filter(ts, lambda e: e <> ''), chr(10)) else coalesce(c, '') end")} x from b where conv in (from k))
select id, 'section' kind, 1::integer lineno, sha256(x) content_sha, lag(id) over (partition by conv order by message_id) follows from u""",
    "ndjson_units": """with l as (select *, row_number() over (partition by user_id order by event_id) no from events), r as (select * from l where event_id % 7 <> 0),
n as (select *, case when event_id % 2 = 0 then event_type else 'L' || no end base from r), s as (select *, row_number() over (partition by user_id, base order by no) k from n)
select 'data:e/' || user_id || '.ndjson::' || base || case when k > 1 then '-' || (k - 1) else '' end id, 'record' kind, cast(no as integer) lineno, case when event_id % 2 = 0 then '{"id": "' || event_type || '", "n": ' || event_id || '}' else '{"n": ' || event_id || '}' end as text from s""",
    "sheet_units": """with c as (select c_nationkey k, c_name || ' | ' || c_custkey || ' | ' || c_mktsegment line, row_number() over (partition by c_nationkey order by c_custkey) no from customer), p as (select *, 'n' || k || case when k % 2 = 0 then '.csv' else '.tsv' end f from c)
select 'data:t/' || f id, 'sheet' kind, 1::integer lineno, 'CSV table ''' || f || ''': ' || count(*) || ' rows x 3 columns.' || chr(10) || 'Columns: name, key, segment' || chr(10) || 'Sample rows:' || chr(10) || string_agg(line, chr(10) order by no) filter (no <= 3) as text from p group by f""",
    "json_units": """with c as (select c_nationkey k, c_custkey, c_name, c_mktsegment, sum(length('"' || c_custkey || '": {"name": "' || c_name || '", "segment": "' || c_mktsegment || '"}, ')) over (partition by c_nationkey) + length('{"more": []}') size from customer),
f as (select distinct k, size from c) select 'data:j/n' || k || '.json::flat' id, 'record' kind, 1::integer lineno, '{"flat": {"nation": ' || k || '}}' as text from f
union all select 'data:j/n' || k || '.json::deep.' || c_custkey, 'record', 1, '{"name": "' || c_name || '", "segment": "' || c_mktsegment || '"}' from c where size > 2048
union all select 'data:j/n' || k || '.json::deep.more', 'record', 1, '[]' from f where size > 2048
union all select 'data:j/n' || k || '.json::deep', 'record', 1, '{"deep": {' || string_agg('"' || c_custkey || '": {"name": "' || c_name || '", "segment": "' || c_mktsegment || '"}', ', ' order by c_custkey::varchar) || ', "more": []}}' from c where size <= 2048 group by k""",
    "python_units": """with n as (select n_nationkey::varchar n from nation where n_nationkey <> 7),
u(name, kind, lineno, line_end, calls, bases, defines, imports, bound) as (values ('', 'module', 1, 20, null, null, 'C#,f#', 'os.path,util', 'os.path,util.helper'), ('::C#', 'class', 4, 14, 'h,self.n,set', 'Base,p.Other', 'C#.m,C#.x,C#.x-1', null, null),
 ('::C#.m', 'function', 5, 6, 'h,self.n', null, null, null, null), ('::C#.x', 'function', 9, 10, '', null, null, null, null), ('::C#.x-1', 'function', 13, 14, 'set', null, null, null, null), ('::f#', 'function', 17, 20, 'g,inner,p.join', null, null, null, null))
select 'code:p/m' || n || '.py' || replace(name, '#', n) id, kind, lineno::integer lineno, line_end::integer line_end, replace(calls, '#', n) calls, replace(bases, '#', n) bases, replace(defines, '#', n) defines, imports, bound from n, u
union all select 'code:p/m7.py', 'file', 1, 1, null, null, null, null, null""",
    "classify_files": rf"""with p as (select distinct source_path path from units where source_path is not null), s as (select regexp_replace(path, '\.[^./]*$', '') st from p),
e as (select path from p union select st || '.odd' from s union select st from s union select st || '.TSV' from s union select st || '.rs' from s union select 'code/plan.py'),
k(ext, category, lang) as (values {_KNOWN}), x as (select path, lower(regexp_extract(path, '[^/]*\.([^./]+)$', 1)) ext from e where length(path) % 5 <> 0)
select path, case when path = 'code/plan.py' then 'doc' else coalesce(category, 'doc') end category, case when path = 'code/plan.py' then 'text' else coalesce(lang, 'text') end lang, category is null ambiguous from x left join k using (ext)""",
}
