"""Extraction and reconciliation: lines and sections, units against nodes, symbols, queues, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memloom.functions.text import WORD, id_tail, subtree, token_estimate
from memloom.operators import units as ops, upkeep
from memloom.operators.ordering import global_positions
from memloom.operators.upkeep import CONFLICT
from memloom.plans import config
from memloom.plans.frames import vertices
from memloom.queries.graphs import ESTIMATE
from memloom.session import materialize, table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.newest_units(table(spark, sf_dir, "units"))


def _file_nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return vertices(table(spark, sf_dir, "nodes"), "source_kind", "source_path", "source_hash", "derived_from_hash", "status", "policy", "type", *columns).where("source_kind = 'derived_from_file'")


def tok_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and occurrences of every word of the corpus."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")).withColumnRenamed("w", "word")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def content_hash_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose text does not have the hash they state, or all that they have none of, counted by kind."""
    rows = table(spark, sf_dir, "units").select("kind", F.sha2("text", 256).eqNullSafe(F.col("content_sha")).alias("same"))
    return rows.groupBy("kind", "same").agg(F.count(F.lit(1)).alias("units"))


def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "units")
    return rows.groupBy("category", "kind", "lang").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("source_path").alias("files"), F.count_if(F.col("text").isNotNull()).alias("with_text"))


def ignore_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that ordered ignore patterns leave out: of all patterns that match the last decides, and one starting with ! takes a path back in."""
    from memloom.sources.ignore import ignored

    paths = table(spark, sf_dir, "units").where("source_path is not null").select(F.col("source_path").alias("path")).distinct()
    return ignored(paths, ["*.json", "plan", "doc/*", "!*record*", "binder*", "*/test_*.py"])


def conflict_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold an open, base or close marker of an unfinished merge at the start of a line; every fiftieth document gets one, at its start or behind its text, and every fiftieth the middle marker, which counts for nothing."""
    mark = F.element_at(F.array(*map(F.lit, ("<<<<<<< ours", "||||||| base", ">>>>>>> theirs", "======="))), (F.floor(F.col("doc_id") / 50) % 4 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 100 == 0, F.concat(mark, F.lit("\n"), "text")).when(F.col("doc_id") % 100 == 50, F.concat("text", F.lit("\n"), mark)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).where(F.col("text").rlike(CONFLICT)).select("doc_id")


def chat_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message once, with the one before it in its session."""
    once = table(spark, sf_dir, "chat_messages").where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("received_at", "conv_id", "seq", "sent_at")).alias("m")).select("message_id", "m.*")
    # Numbered over all sessions by a range-partitioned sort, so that no session is one task; the one before is a join on the number.
    at = materialize(global_positions(once.where("conv_id is not null"), [F.col("conv_id"), F.asc_nulls_last("seq"), F.col("sent_at"), F.col("message_id")], "at", "sessions").select("conv_id", "message_id", "at"), "numbered")
    before = at.select(F.col("conv_id").alias("of"), F.col("message_id").alias("follows"), (F.col("at") + 1).alias("at"))
    return at.join(before, "at", "left").select("conv_id", "message_id", F.when(F.col("of") == F.col("conv_id"), F.col("follows")).alias("follows"))


def dup_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur again in a file get their number, 1 for the second."""
    rows = table(spark, sf_dir, "units").where("id is not null and source_path is not null").select("id", "source_path", "lineno", F.regexp_replace(id_tail(F.col("id")), "[-.]?[0-9]+$", "").alias("stem")).distinct()
    n = F.row_number().over(Window.partitionBy("source_path", "stem").orderBy(F.asc_nulls_first("lineno"), "id")) - 1
    return rows.select("id", "lineno", F.when(n > 0, F.concat("stem", F.lit("-"), n)).otherwise(F.col("stem")).alias("unique_name"))


def diff_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.diff_classes(_units(spark, sf_dir), _file_nodes(spark, sf_dir))


def _moved(units: DataFrame) -> DataFrame:
    """The units after a move: those of every path of a length that three divides lie in another folder."""
    gone = F.length("source_path") % 3 == 0
    there = lambda c: F.regexp_replace(c, "^([^:]*:)?", "$1moved/")
    return units.withColumn("id", F.when(gone, there("id")).otherwise(F.col("id"))).withColumn("source_path", F.when(gone, F.concat(F.lit("moved/"), "source_path")).otherwise(F.col("source_path")))


def _moves(u: DataFrame, n: DataFrame) -> DataFrame:
    gone = n.where("policy = 'mirror'").join(u.select("id"), "id", "left_anti").select("id", F.col("source_hash").alias("sha"))
    come = u.join(n.select("id"), "id", "left_anti").select("id", F.col("content_sha").alias("sha"))
    return ops.paired_moves(gone, come)


def move_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vanished nodes of mirrored files paired with new units of the same content, after a move of some files."""
    return _moves(_moved(_units(spark, sf_dir)), _file_nodes(spark, sf_dir))


def moved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the files that moved, with targets and memberships that follow them."""
    u, nodes = _moved(_units(spark, sf_dir)), table(spark, sf_dir, "nodes")
    out = upkeep.moved_nodes(vertices(nodes, "source_path", "derived_from_hash", "status", "part_of", "edges"), _moves(u, _file_nodes(spark, sf_dir)), u)
    return out.withColumn("topics", F.array_join("topics", "|")).withColumn("targets", F.array_join("targets", "|"))


def policy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units seen under more than one policy; in the newest snapshot every fifth path (by its length) has become absorb_once."""
    rows = table(spark, sf_dir, "unit_snapshots").where("id is not null")
    newest = rows.agg(F.max("snap_no").alias("newest"))
    rows = rows.crossJoin(F.broadcast(newest)).withColumn("policy", F.when((F.col("snap_no") == F.col("newest")) & (F.length("source_path") % 5 == 0), "absorb_once").otherwise(F.col("policy")))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("policy")).alias("p")).where(F.size("p") > 1).select("id", F.array_join("p", ",").alias("policies"))


def _using(units: DataFrame) -> DataFrame:
    """The units and, for every module, one that imports it and whose functions call, inherit and follow each of its top-level symbols."""
    own = units.select("id", "source_path", "qualname", "kind", "imports", "import_bindings", "calls", "bases", "follows")
    path = F.concat(F.lit("gen/use_"), F.translate("source_path", "/", "_"))
    name = ops.dotted(F.col("source_path"))
    module = own.where("kind = 'module' and source_path is not null").select("source_path").distinct()
    none = F.lit(None)
    user = module.select(
        F.concat(F.lit("code:"), path).alias("id"), path.alias("source_path"), none.cast("string").alias("qualname"), F.lit("module").alias("kind"), F.array(name).alias("imports"), F.create_map(F.lit("m"), name).alias("import_bindings"),
        none.cast("array<string>").alias("calls"), none.cast("array<string>").alias("bases"), none.cast("string").alias("follows"),
    )
    top = own.where("qualname <> '' and qualname not like '%.%'").join(module, "source_path", "left_semi")
    symbol = F.array(F.concat(F.lit("m."), "qualname"))
    users = top.select(
        F.concat(F.lit("code:"), path, F.lit("::use_"), "qualname").alias("id"), path.alias("source_path"), F.concat(F.lit("use_"), "qualname").alias("qualname"), F.lit("function").alias("kind"), none.cast("array<string>").alias("imports"),
        none.cast("map<string,string>").alias("import_bindings"), symbol.alias("calls"), symbol.alias("bases"), F.col("id").alias("follows"),
    )
    return own.unionByName(user).unionByName(users)


def module_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every imported or called dotted name with the longest prefix of it that names a module."""
    u = _using(_units(spark, sf_dir))
    names = ops.module_names(u.where("kind = 'module'").select(F.col("source_path").alias("path")).distinct())
    written = u.select(F.explode(F.concat(F.coalesce("imports", F.array().cast("array<string>")), F.coalesce(F.map_values("import_bindings"), F.array().cast("array<string>")), F.transform(F.coalesce("calls", F.array().cast("array<string>")), lambda c: F.concat(F.lit("src."), c)))).alias("written")).where("written <> ''")
    return ops.longest_module(written, names)


def suffix_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that name no node but end like exactly one."""
    ids = vertices(table(spark, sf_dir, "nodes"))
    targets = table(spark, sf_dir, "links").where("target is not null").select("target").distinct().join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    shorter = ids.select(F.regexp_replace("id", r"^([^:]*:)[^/]*/", "$1").alias("target")).distinct().join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    return ops.repaired_targets(targets.unionByName(shorter).distinct(), ids)


def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that extraction alone supports, over the units and users of them."""
    return ops.structural_edges(_using(_units(spark, sf_dir)))


def trivial_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of at most three lines that need no judged summary: their own text on one line, 240 characters at most."""
    rows = _units(spark, sf_dir).where("category = 'code' and kind = 'function' and trim(coalesce(text, '')) <> '' and lineno > 0 and line_end > 0")
    rows = rows.where((F.col("line_end") - F.col("lineno") + 1 <= config.profile("template")["trivial_lines"]) & ~F.coalesce(F.element_at(F.split("qualname", r"\."), -1).isin(*config.PROTOCOL_METHODS), F.lit(False)))
    return rows.select("id", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 240).alias("summary"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose node is missing or lags."""
    change = diff_classes(spark, sf_dir).where("change in ('added', 'changed', 'lagging')")
    return _units(spark, sf_dir).join(change, "id").select("id", "kind", "category", "source_path", "text", "change")


def queue_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select("id", "kind", "change")


def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.queue_batches(_queue(spark, sf_dir), 2, 60, 120_000)


def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category and kind with their subtotals and the whole."""
    rows = _queue(spark, sf_dir).withColumn("subtree", subtree(F.col("source_path"), 1))
    return rows.rollup("category", "kind").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("text").isNotNull()).alias("with_text"), F.count_distinct("subtree").alias("subtrees"))


def queue_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to derive first: whole files and classes before their parts, and directories that were used before others."""
    used = table(spark, sf_dir, "links").where("coact > 0").select(F.col("source").alias("id")).distinct().withColumn("used", F.lit(True))
    rows = _queue(spark, sf_dir).join(used, "id", "left")
    first = F.col("kind").isin("module", "class", "package", "file") | F.coalesce("used", F.lit(False))
    return rows.select("id", F.when(first, "priority").otherwise("deferred").alias("part"))


def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.verified_claims(_file_nodes(spark, sf_dir), _units(spark, sf_dir))


def cache_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that can be taken over: a queued unit whose content, kind (the contract) and language some node with a summary has; the smallest such node."""
    units = _units(spark, sf_dir)
    lang = F.lower(F.coalesce("lang", F.lit("")))
    wanted = _queue(spark, sf_dir).select("id").join(units.select("id", "content_sha", "kind", lang.alias("lang")), "id")
    told = vertices(table(spark, sf_dir, "nodes"), "summary").where("trim(coalesce(summary, '')) <> ''")
    have = units.join(told, "id").groupBy("content_sha", "kind", lang.alias("lang")).agg(F.min(F.struct("id", "summary")).alias("c"))
    return wanted.join(have, ["content_sha", "kind", "lang"]).select("id", F.col("c.id").alias("source_id"), F.col("c.summary").alias("summary"))


QUERIES = {
    f.__name__: f
    for f in (
        tok_word_stats, token_estimates, content_hash_units, extraction_stats, ignore_match, conflict_markers, chat_follows, dup_suffix,
        diff_classes, move_pairs, moved_nodes, policy_conflicts, module_prefix, suffix_repair, structural_edges, trivial_units, queue_refresh, queue_batches, queue_summary, queue_priority, verify_claims, cache_restore,
    )
}

_U = "un as (select * from (select *, row_number() over (partition by id order by extracted_at desc nulls last, content_sha desc nulls last) r_ from units where id is not null) where r_ = 1)"
_F = "fn as (select distinct on (id) * from nodes where id is not null and source_kind = 'derived_from_file')"
_D = """df as (select coalesce(un.id, fn.id) id, case when fn.id is null then 'added' when un.id is null then case when fn.policy = 'mirror' then 'deleted' else 'kept' end when fn.policy = 'absorb_once' then 'frozen'
  when un.content_sha is distinct from fn.source_hash then 'changed' when fn.derived_from_hash is distinct from fn.source_hash or fn.status = 'stale' then 'lagging' else 'unchanged' end change from un full join fn on un.id = fn.id)"""
_Q = "qu as (select un.*, change from un join df using (id) where change in ('added', 'changed', 'lagging'))"
_QUEUE = f"with recursive {_U}, {_F}, {_D}, {_Q}"
_SUB = "case when source_path is null or source_path not like '%/%' then '_root' else array_to_string(list_slice(string_split(source_path, '/'), 1, least({0}, len(string_split(source_path, '/')) - 1)), '/') end"
_MOD = r"""mo as (select distinct source_path path, string_split(regexp_replace(replace(regexp_replace(source_path, '\.[A-Za-z0-9]+$', ''), '/', '.'), '\.__init__$', ''), '.') ps from un where kind = 'module'),
mn as (select name, min(path) path from (select path, array_to_string(ps[i:], '.') as name from (select path, ps, unnest(range(1, len(ps) + 1)) i from mo)) group by name having min(path) = max(path))"""
_LONG = """lp as (select written, arg_max(path, k) path, max(k) k from (select written, k, array_to_string(string_split(written, '.')[1:k], '.') as name from (select distinct written, unnest(range(1, len(string_split(written, '.')) + 1)) k from wr)) join mn using (name) group by written),
lm as (select written, path, array_to_string(string_split(written, '.')[k + 1:], '.') rest from lp)"""

_MV = """um as (select * replace (case when length(source_path) % 3 = 0 then regexp_replace(id, '^([^:]*:)?', '\\1moved/') else id end as id, case when length(source_path) % 3 = 0 then 'moved/' || source_path else source_path end as source_path) from un),
g as (select id, source_hash sha, row_number() over (partition by source_hash order by id) k from fn where policy = 'mirror' and source_hash is not null and id not in (select id from um)),
c as (select id, content_sha sha, row_number() over (partition by content_sha order by id) k from um where content_sha is not null and id not in (select id from fn)), mp as (select g.id old_id, c.id new_id from g join c using (sha, k))"""
_DOT = r"regexp_replace(replace(regexp_replace({0}, '\.[A-Za-z0-9]+$', ''), '/', '.'), '\.__init__$', '')"
_UU = f"""{_U.replace("un as", "u0 as", 1)}, md as (select distinct source_path from u0 where kind = 'module' and source_path is not null),
un as (select id, source_path, qualname, kind, imports, import_bindings, calls, bases, follows from u0
 union all select 'code:gen/use_' || replace(source_path, '/', '_'), 'gen/use_' || replace(source_path, '/', '_'), null, 'module', [{_DOT.format("source_path")}], map(['m'], [{_DOT.format("source_path")}]), null, null, null from md
 union all select 'code:gen/use_' || replace(source_path, '/', '_') || '::use_' || qualname, 'gen/use_' || replace(source_path, '/', '_'), 'use_' || qualname, 'function', null, null, ['m.' || qualname], ['m.' || qualname], id from u0
  where qualname <> '' and qualname not like '%.%' and source_path in (from md))"""

SQL = {
    "tok_word_stats": r"select word, count(distinct doc_id) documents, count(*) occurrences from (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) word from documents) group by word",
    "token_estimates": f"select doc_id, cast({ESTIMATE.format('t')} as integer) tokens from (select doc_id, coalesce(text, '') t from documents)",
    "content_hash_units": "select kind, sha256(text) is not distinct from content_sha same, count(*) units from units group by 1, 2",
    "extraction_stats": "select category, kind, lang, count(*) units, count(distinct source_path) files, count(text) with_text from units group by 1, 2, 3",
    "ignore_match": r"""with p as (select distinct source_path path from units where source_path is not null),
pt(ord, neg, pat) as (values (0, false, '*.json'), (1, false, 'plan'), (2, false, 'doc/*'), (3, true, '*record*'), (4, false, 'binder*'), (5, false, '*/test_*.py')),
h as (select path, ord, neg from p, pt where path glob pat or list_contains(list_transform(string_split(path, '/'), lambda s: s glob pat), true) or path glob (pat || '/*'))
select path from h group by path having arg_max(not neg, ord)""",
    "conflict_markers": r"""with m as (select doc_id, ['<<<<<<< ours', '||||||| base', '>>>>>>> theirs', '======='][doc_id // 50 % 4 + 1] m, text from documents), t as (select doc_id, case doc_id % 100 when 0 then m || chr(10) || text when 50 then text || chr(10) || m else text end t from m)
select doc_id from t where regexp_matches(t, '(^|\n)(<<<<<<<|\|\|\|\|\|\|\||>>>>>>>)( |\n|$)')""",
    "chat_follows": """with o as (select message_id, arg_min(row(conv_id, seq, sent_at), received_at) m from chat_messages where message_id is not null group by 1)
select m[1] conv_id, message_id, lag(message_id) over (partition by m[1] order by m[2] nulls last, m[3], message_id) follows from o""",
    "dup_suffix": r"""with r as (select distinct id, source_path, lineno, regexp_replace(regexp_replace(id, '^[^:]*:', ''), '[-.]?[0-9]+$', '') stem from units where id is not null and source_path is not null),
n as (select *, row_number() over (partition by source_path, stem order by lineno nulls first, id) - 1 n from r) select id, lineno, case when n > 0 then stem || '-' || n else stem end unique_name from n""",
    "diff_classes": f"with {_U}, {_F}, {_D} select id, change from df",
    "move_pairs": f"with {_U}, {_F}, {_MV} select old_id, new_id from mp",
    "moved_nodes": rf"""with {_U}, {_F}, {_MV}, o as (select mp.old_id, fn.source_path op, fn.derived_from_hash dh, fn.status st, fn.part_of po, fn.edges ed, um.id id, um.source_path np, um.category cat, um.content_sha sha from mp join fn on fn.id = mp.old_id join um on um.id = mp.new_id),
h as (select *, case when contains(op, '/') then regexp_replace(op, '/[^/]*$', '') else cat end oh, case when contains(np, '/') then regexp_replace(np, '/[^/]*$', '') else cat end nh from o),
t as (select *, list_filter(list_transform(coalesce(po, []), lambda p: case when p.topic = oh then nh else p.topic end), lambda x: coalesce(x, '') <> '') ts from h)
select old_id, id, np source_path, case when dh is not distinct from sha then coalesce(st, 'active') else 'stale' end status, dh is distinct from sha or coalesce(st, 'active') = 'stale' requeue,
 case when len(ts) > 0 then array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), '|') else nh end topics,
 coalesce(array_to_string(list_transform(coalesce(ed, []), lambda e: case when e.to = 'code:' || op or starts_with(e.to, 'code:' || op || '::') then 'code:' || np || substr(e.to, length('code:' || op) + 1) else e.to end), '|'), '') targets from t""",
    "policy_conflicts": "select id, array_to_string(list_sort(list(distinct p)), ',') policies from (select id, case when snap_no = (select max(snap_no) from unit_snapshots where id is not null) and length(source_path) % 5 = 0 then 'absorb_once' else policy end p from unit_snapshots where id is not null) where p is not null group by id having count(distinct p) > 1",
    "module_prefix": f"with {_UU}, {_MOD}, wr as (select written from (select unnest(imports) written from un union select unnest(map_values(import_bindings)) from un union select 'src.' || unnest(calls) from un) where written <> ''), {_LONG} select written, path, rest from lm",
    "suffix_repair": r"""with v as (select distinct id from nodes where id is not null), cand as (select distinct target from links where target is not null union select regexp_replace(id, '^([^:]*:)[^/]*/', '\1') from v),
tg as (select target from cand where target not in (select id from v)),
cut as (select id, regexp_extract(id, '^([^:]*):', 1) cat, string_split(regexp_replace(regexp_replace(id, '^[^:]*:', ''), '::.*$', ''), '/') ps, case when id like '%::%' then regexp_replace(id, '^.*?::', '') else '' end q from v),
sx as (select cat, q, array_to_string(ps[i:], '/') path, id from (select *, unnest(range(2, len(ps) + 1)) i from cut)), one as (select cat, q, path, min(id) id from sx group by 1, 2, 3 having min(id) = max(id)),
tc as (select target, regexp_extract(target, '^([^:]*):', 1) cat, regexp_replace(regexp_replace(target, '^[^:]*:', ''), '::.*$', '') path, case when target like '%::%' then regexp_replace(target, '^.*?::', '') else '' end q from tg)
select target, id from tc join one using (cat, path, q)""",
    "structural_edges": rf"""with {_UU}, {_MOD}, fl as (select source_path, id mid from un where kind = 'module'), qn as (select source_path, qualname, min(id) id from un where qualname is not null group by 1, 2),
de as (select q.id src, un.id dst from un join qn q on q.source_path = un.source_path and q.qualname = regexp_replace(un.qualname, '\.[^.]*$', '') where un.qualname like '%.%'
  union select mid, un.id from un join fl using (source_path) where qualname is not null and qualname not like '%.%'),
us as (select distinct id, source_path, qualname, rel, name, regexp_extract(name, '^[^.]+', 0) head from (select id, source_path, qualname, 'calls' rel, unnest(calls) as name from un union all select id, source_path, qualname, 'inherits', unnest(bases) from un) where name is not null and name <> ''),
ul as (select *, case when head in ('self', 'cls') and coalesce(qualname, '') like '%.%' then regexp_extract(qualname, '^(.*)\.[^.]*$', 1) || substr(name, length(head) + 1) else name end as loc from us),
bi as (select source_path, head, min(bound) bound from (select source_path, unnest(map_keys(import_bindings)) head, unnest(map_values(import_bindings)) bound from un) group by 1, 2),
ur as (select ul.*, qn.id here, case when qn.id is null and bound is not null then bound || substr(name, length(ul.head) + 1) end written from ul left join qn on qn.source_path = ul.source_path and qn.qualname = ul.loc left join bi on bi.source_path = ul.source_path and bi.head = ul.head),
im as (select distinct id, unnest(imports) written from un), wr as (select written from ur where written is not null union select written from im where written is not null and written <> ''), {_LONG},
th as (select written, qn.id there from lm join qn on qn.source_path = lm.path and qn.qualname = lm.rest),
mi as (select source_path path, min(mid) mid from fl group by 1)
select src, 'defines' rel, dst, 1.0::double w from de where src <> dst
union select id, rel, coalesce(here, there), case when rel = 'calls' then 0.7::double else 0.8::double end from ur left join th using (written) where coalesce(here, there) is not null and coalesce(here, there) <> id
union select im.id, 'imports', mid, 0.6::double from im join lm using (written) join mi using (path) where im.id <> mid
union select id, 'follows', follows, 0.3::double from un where follows is not null""",
    "trivial_units": rf"with {_U} select id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240) summary from un where category = 'code' and kind = 'function' and trim(coalesce(text, '')) <> '' and lineno > 0 and line_end > 0 and line_end - lineno + 1 <= 3 and coalesce(string_split(qualname, '.')[-1] not in {config.PROTOCOL_METHODS}, true)",
    "queue_refresh": f"{_QUEUE} select id, kind, change from qu",
    "queue_batches": f"""{_QUEUE}, r as (select {_SUB.format(2)} part, id, length(coalesce(text, '')) n, row_number() over (partition by {_SUB.format(2)} order by id) k from qu),
f as (select part, id, k, 1 batch, 1 cnt, n::bigint sz from r where k = 1 union all
  select r.part, r.id, r.k, f.batch + case when f.cnt >= 60 or f.sz + r.n > 120000 then 1 else 0 end, case when f.cnt >= 60 or f.sz + r.n > 120000 then 1 else f.cnt + 1 end, case when f.cnt >= 60 or f.sz + r.n > 120000 then r.n else f.sz + r.n end from f join r on r.part = f.part and r.k = f.k + 1)
select part, batch, cast(k as integer) ord, id from f""",
    "queue_summary": f"{_QUEUE} select category, kind, count(*) units, count(text) with_text, count(distinct {_SUB.format(1)}) subtrees from qu group by rollup (category, kind)",
    "queue_priority": f"{_QUEUE} select id, case when kind in ('module', 'class', 'package', 'file') or id in (select source from links where coact > 0) then 'priority' else 'deferred' end part from qu",
    "verify_claims": f"""with {_U}, {_F} select fn.id, case when fn.source_path not in (select source_path from un where source_path is not null) or fn.source_path is null or un.id is null then 'contradicted' when un.content_sha is not distinct from fn.source_hash then 'verified' else 'stale' end verdict,
case when fn.source_path like '%.py' then 'ast' when fn.type in ('module', 'class', 'function', 'method', 'file') then 'grep' else 'doc' end method from fn left join un on un.id = fn.id""",
    "cache_restore": f"""{_QUEUE}, vx as (select distinct on (id) * from nodes where id is not null), h as (select un.content_sha, un.kind, lower(coalesce(un.lang, '')) lang, arg_min(row(un.id, vx.summary), un.id) c from un join vx on vx.id = un.id where trim(coalesce(vx.summary, '')) <> '' group by 1, 2, 3)
select qu.id, c[1] source_id, c[2] summary from qu join h on h.content_sha = qu.content_sha and h.kind = qu.kind and h.lang = lower(coalesce(qu.lang, ''))""",
}
