"""The queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memloom.llm.components import connected_groups
from memloom.llm.conversations import rebuild_conversations
from memloom.llm.cooccurrence import counting_links, item_pairs
from memloom.llm.leakage import leaked_items
from memloom.llm.neardup import near_duplicates, record_pairs, unfiled_nodes
from memloom.llm.quality import outlier_scores, tail_probabilities
from memloom.llm.splitting import LIMIT, OVERLAP, split_units
from memloom.llm.tokenizer import decode_corpus, encode_corpus
from memloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(table(spark, sf_dir, "duplicate_pairs").where("verdict = 'same'").select("a", "b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = item_pairs(counting_links(table(spark, sf_dir, "links")), "source", "target", min_common=5, min_lift=4)
    return found.select("item_a", "item_b")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of targets with a common source, with counts, lift and conviction."""
    found = item_pairs(counting_links(table(spark, sf_dir, "links")), "source", "target")
    return found.select("item_a", "item_b", "common", "count_a", "count_b", "baskets", F.round("lift", 9).alias("lift"), F.round("conviction", 9).alias("conviction"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_no = 1").select("id", "content_sha")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_units(table(spark, sf_dir, "units"))


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit that was cut, put together again from its pieces: its length, the hash of the whole, and whether every piece keeps the limit and repeats the end of the one before."""
    pieces = p3_pieces(spark, sf_dir)
    before = F.lag(F.struct("char_end", "text")).over(Window.partitionBy("id", "content_sha").orderBy("piece_no"))
    fresh = F.when(F.col("piece_no") == 1, F.col("text")).otherwise(F.expr(f"substring(text, {OVERLAP + 1})"))
    repeats = F.col("b").isNull() | ((F.col("char_start") == F.col("b.char_end") - OVERLAP) & (F.expr(f"right(b.text, {OVERLAP})") == F.expr(f"left(text, {OVERLAP})")))
    rows = pieces.withColumn("b", before).withColumn("keeps", repeats & (F.length("text") <= LIMIT) & (F.length("text") == F.col("char_end") - F.col("char_start")))
    out = rows.groupBy("id", "content_sha").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda x: x["t"]), "").alias("whole"), F.bool_and("keeps").alias("keeps"))
    return out.select("id", "content_sha", F.length("whole").alias("chars"), F.sha2("whole", 256).alias("sha"), "keeps")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = near_duplicates(unfiled_nodes(table(spark, sf_dir, "nodes")), "id", F.col("said"))
    return record_pairs(members, pairs).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_conversations(table(spark, sf_dir, "chat_messages"))


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_conversations(table(spark, sf_dir, "chat_messages"), with_content=True)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the number of its ids and whether decoding them gives the stored text (null as empty) back."""
    documents = table(spark, sf_dir, "documents")
    encoded = encode_corpus(documents)
    back = decode_corpus(encoded).select("doc_id", F.sha2("text", 256).alias("back"))
    given = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("given"))
    return given.join(back, "doc_id").select("doc_id", (F.col("given") == F.col("back")).alias("same"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents that contain part of them."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain a whole item with at most two of its words inserted, deleted or replaced (one for every six words)."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=None, edits=2).select("doc_id", "item_id", "first_word", "edits")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("score > 0").select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p10_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact tail probabilities, by language tag, of three statistics that SQL counts alike: characters, digits and lines of the documents with text."""
    tag = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "^[a-z]{2,3}", 0)
    size = F.length("text")
    stats = {"chars": size, "digits": size - F.length(F.regexp_replace("text", "[0-9]", "")), "lines": size - F.length(F.regexp_replace("text", "\n", "")) + 1}
    rows = table(spark, sf_dir, "documents").where("text is not null").select(tag.alias("tag"), F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), c.cast("bigint").alias("value")) for k, c in stats.items()])).alias("s")).select("tag", "s.stat", "s.value")
    return tail_probabilities(rows, ["tag", "stat"], "value").select("tag", "stat", "value", F.round("at_most", 9).alias("at_most"), F.round("at_least", 9).alias("at_least"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_pairs, p3_found, p3_pieces, p3_rejoined, p5_found, p6_found, p6_conversations, p8_ids, p8_roundtrip, p9_found, p9_items, p9_edits, p10_found, p10_scores, p10_tails)}

_LINKS = "select distinct source s, target t from links where coact > 0 and target is not null and target <> source"
_PAIRS = f"""
with l as ({_LINKS}), n as (select t, count(*) c from l group by t), m as (select count(distinct s) b from l),
p as (select x.t item_a, y.t item_b, count(*) common from l x join l y on x.s = y.s and x.t < y.t group by 1, 2)
select item_a, item_b, common, a.c count_a, b.c count_b, m.b baskets, round(common * m.b::double / (a.c::double * b.c), 9) lift,
 case when common < a.c then round((1 - b.c / m.b::double) / (1 - common / a.c::double), 9) end conviction
from p join n a on a.t = item_a join n b on b.t = item_b cross join m"""

SQL = {
    "p1_found": """
with recursive l as (select a, b from duplicate_pairs where verdict = 'same' and a is not null and b is not null and a <> b),
e as (select a, b from l union select b, a from l),
r as (select a x, a y from e union select r.x, e.b from r join e on e.a = r.y)
select x record_id, min(y) group_id from r group by x""",
    "p2_found": f"select item_a, item_b from ({_PAIRS}) where common >= 5 and common * baskets >= 4 * count_a * count_b",
    "p2_pairs": _PAIRS,
    "p3_found": "select distinct id, content_sha from units where length(text) > 3000",
    "p3_rejoined": "select id, content_sha, length(max(text)) chars, sha256(max(text)) sha, true keeps from units where length(text) > 3000 group by id, content_sha",
    "p8_roundtrip": "select doc_id, true same from documents",
    "p5_found": r"""
with d as (select id, max(concat_ws(' ', summary, body)) t from nodes where source_kind <> 'derived_from_file' and id is not null group by id),
k as (select id, unnest(list_distinct(list_transform(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: lower(x)))) w from d),
n as (select id, count(*) c from k group by id),
p as (select x.id a, y.id b, count(*) i from k x join k y on x.w = y.w and x.id < y.id group by 1, 2)
select p.a node_a, p.b node_b from p join n x on x.id = p.a join n y on y.id = p.b where 100 * i >= 82 * (x.c + y.c - i)""",
    "p6_found": r"""
with m as (select message_id, arg_min(struct_pack(conv_id, seq, role, content, sent_at), received_at) r from chat_messages where message_id is not null and conv_id is not null group by 1),
t as (select message_id, r.conv_id, r.seq, r.sent_at, r.content, regexp_replace(trim(lower(r.role)), '\s*:?\s*$', '') who,
  case when try_cast(r.content as json) is not null and json_type(try_cast(r.content as json)) = 'ARRAY'
    then coalesce(list_aggregate(try_cast(json_extract_string(r.content, '$[*].text') as varchar[]), 'string_agg', ' '), '') else r.content end said from m),
u as (select *, case when who in ('user', 'human') then 'user' when who in ('assistant', 'ai', 'bot', 'model') then 'assistant' when who in ('system', 'developer') then 'system' end spk,
  coalesce(regexp_matches(said, '\S'), false) ok, count(seq) over c ns, count(*) over c n, row_number() over (partition by conv_id order by case when seq is null then 1 else 0 end, seq, sent_at, message_id) rn from t window c as (partition by conv_id)),
v as (select *, lag(spk) over (partition by conv_id order by rn) prev from u),
g as (select conv_id from v group by conv_id having bool_and(ok and spk is not null) and (max(ns) = 0 or (max(ns) = max(n) and bool_and(seq = rn)))
  and bool_and(case when rn = 1 then spk in ('system', 'user') when spk = 'system' then prev = 'system' when spk = 'user' then prev in ('system', 'assistant') else prev = 'user' end)
  and max_by(spk, rn) = 'assistant')
select conv_id, cast(rn as integer) pos, message_id from v join g using (conv_id)""",
    "p9_found": r"""
with i as (select item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) ws from eval_items where text is not null),
d as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) ws from documents where text is not null),
s as (select distinct least(12, len(ws)) k from i where len(ws) > 0),
iw as (select item_id, least(12, len(ws)) k, ws[p : p + least(12, len(ws)) - 1] g from (select *, unnest(range(1, len(ws) - least(12, len(ws)) + 2)) p from i where len(ws) > 0)),
dw as (select distinct doc_id, k, ws[p : p + k - 1] g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) p from d join s on len(ws) >= k))
select distinct doc_id, item_id from iw join dw using (k, g)""",
}
SQL["p9_items"] = f"select item_id, count(*) documents from ({SQL['p9_found']}) group by 1"
SQL["p6_conversations"] = SQL["p6_found"].replace("'string_agg', ' '", "'string_agg', chr(10)").replace("pos, message_id from v join", "pos, message_id, spk as role, said as content from v join")
SQL["p10_tails"] = r"""
with d as (select regexp_extract(lower(trim(coalesce(lang, ''))), '^[a-z]{2,3}', 0) tag, text t from documents where text is not null),
v as (select tag, 'chars' stat, length(t) v from d union all select tag, 'digits', length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) from d union all select tag, 'lines', length(t) - length(replace(t, chr(10), '')) + 1 from d)
select tag, stat, cast(v as bigint) as value, round(max(c), 9) at_most, round(max(e), 9) at_least
from (select *, cume_dist() over (partition by tag, stat order by v) c, cume_dist() over (partition by tag, stat order by v desc) e from v) group by 1, 2, 3"""
