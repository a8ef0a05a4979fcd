"""Similarity, learning from use, consolidation and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from memloom.functions.text import search_text, slug, tokens
from memloom.operators import learning as ops, upkeep
from memloom.operators.graph import degrees, resolved
from memloom.operators.merging import merged_nodes
from memloom.operators.similar import cosine_top, lexical_top, token_near_duplicates
from memloom.operators.snapshots import edited_files
from memloom.operators.skew import small_side
from memloom.plans import config
from memloom.plans.frames import edges, memberships, vertices
from memloom.plans.held import held
from memloom.plans.retrieve import retrieve
from memloom.queries.graphs import protected_nodes
from memloom.queries.reconciling import _D, _F, _U, verify_claims
from memloom.queries.retrieval import _START, BASE, GRAPH, SEEDS, _active, _asked, _exact, _packed, _ppr, retrieve_pack
from memloom.session import materialize, table

SETTINGS = config.profile()
#: Ages are counted from here, so that a run can be repeated.
NOW = "2024-11-01 00:00:00"


def cosine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every vector from a cosine of 0.35 on."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cosine_top(vectors, SETTINGS["linker_top"], SETTINGS["linker_similarity"]).select("id", "other", "rank", F.round("sim", 6).alias("sim"))


def lexical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linker without vectors: for every node with a summary that is not stale the five most similar nodes, by the words it is found by, of another bucket or another file, that are neither linked nor judged."""
    nodes = table(spark, sf_dir, "nodes")
    # What a node is found by is cut, and left out where it does not count, before the rows of an id meet.
    said = F.when(F.expr("trim(coalesce(summary, '')) <> '' and coalesce(status, 'active') <> 'stale'"), search_text(F.col("id"), F.col("summary"), F.col("part_of"), F.col("tags"), F.col("body")))
    docs = vertices(nodes.withColumn("said", said), "bucket", "source_path", "said").where("said is not null").select("id", tokens(F.col("said")).alias("tokens"), "bucket", F.col("source_path").alias("path"))
    return lexical_top(docs, link_pairs(spark, sf_dir), SETTINGS["linker_top"])


def _episodic() -> Column:
    return F.col("type").isin(*SETTINGS["episodic"]) & (F.coalesce("source_kind", F.lit("")) != "derived_from_file")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodic nodes whose summary and first 400 characters of body have 0.82 of their words in common."""
    said = F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.substring(F.coalesce("body", F.lit("")), 1, 400))
    # What a node says is cut, and left out where it does not count, before the rows of an id meet.
    nodes = table(spark, sf_dir, "nodes").withColumn("said", F.when(_episodic(), said))
    found = token_near_duplicates(vertices(nodes, "said").where("said is not null").select("id", tokens(F.col("said")).alias("tokens")), SETTINGS["near_duplicate"])
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


def link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs that need no judging again: linked already, or judged."""
    linked = edges(table(spark, sf_dir, "nodes")).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    judged = table(spark, sf_dir, "duplicate_pairs").where("verdict is not null").select(F.col("a").alias("x"), F.col("b").alias("y"))
    return linked.unionByName(judged).where("x is not null and y is not null and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible nodes in batches of eighty in the order of ids."""
    from memloom.operators.ordering import global_positions

    rows = vertices(table(spark, sf_dir, "nodes"), "summary", "status").where("trim(coalesce(summary, '')) <> '' and coalesce(status, 'active') <> 'stale'").select("id")
    return global_positions(rows, [F.col("id")]).select("id", F.floor((F.col("_pos") - 1) / SETTINGS["batch_nodes"]).cast("int").alias("batch"))


def judged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which batches of four nodes retire: those of which every node was judged in some pass."""
    from memloom.operators.ordering import global_positions

    rows = vertices(table(spark, sf_dir, "nodes"), "type").where("type in ('note', 'decision', 'adr')").select("id")
    batches = global_positions(rows, [F.col("id")]).select("id", F.floor((F.col("_pos") - 1) / 4).cast("int").alias("batch"))
    judged = table(spark, sf_dir, "duplicate_pairs").where("verdict is not null").select(F.explode(F.array("a", "b")).alias("id")).where("id is not null")
    return upkeep.retired_batches(batches, judged)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a session; what was bought was accepted, what failed was taken back."""
    outcome = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "reverted")
    return table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("session"), outcome.alias("outcome"), F.get_json_object("props", "$.k").cast("int").alias("item"))


def usage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.usage_pairs(_sessions(spark, sf_dir))


def usage_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each case's pack the nodes whose file was edited in the newest snapshot step."""
    own = vertices(table(spark, sf_dir, "nodes"), "source_path").join(edited_files(table(spark, sf_dir, "unit_snapshots")), "source_path", "left_semi")
    return retrieve_pack(spark, sf_dir).select("case_id", "id").join(own, "id").select("case_id", "id", "source_path")


def coactivation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pair_counts(table(spark, sf_dir, "links").where("coact > 0"), "source", "target")


def fold_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges after a fold of what was seen together and how judging went."""
    pairs = table(spark, sf_dir, "duplicate_pairs").where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "verdict")
    seen = coactivation_counts(spark, sf_dir)
    own = edges(table(spark, sf_dir, "nodes")).select("src", "pos", "rel", "dst", "w", "coact")
    out = ops.fold_weights(own, seen, pairs.where("verdict = 'same'"), pairs.where("verdict = 'different'"), SETTINGS["hebbian"], SETTINGS["decay"], SETTINGS["prune"], config.EDGE_WEIGHT)
    return out.select("src", "rel", "dst", F.round("w", 6).alias("w"), F.col("coact").cast("bigint").alias("coact"))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    ids, e = vertices(nodes), edges(nodes)
    deg = degrees(e, ids)
    own = e.groupBy(F.col("src").alias("id")).agg(F.sum(F.coalesce("coact", F.lit(0))).alias("coact"), F.bool_or(F.coalesce(F.col("rel").isin(*config.GROUND_RELS), F.lit(False))).alias("out"))
    grounded = resolved(e.where(F.col("rel").isin(*config.GROUND_RELS)), ids).select(F.col("dst").alias("id"), F.lit(True).alias("into")).distinct()
    rows = vertices(nodes, "type", "status", "updated", "source_kind", "summary").join(deg, "id").join(own, "id", "left").join(grounded, "id", "left")
    rows = rows.crossJoin(F.broadcast(deg.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top_degree"))))
    rows = rows.withColumn("grounded", (F.coalesce("source_kind", F.lit("")) == "derived_from_file") | F.coalesce("into", F.lit(False)) | F.coalesce("out", F.lit(False)))
    return rows.withColumn("salience", ops.salience(F.lit(NOW).cast("timestamp"), SETTINGS))


def salience_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty episodic nodes that are worth least."""
    rows = _valued(spark, sf_dir).where(F.col("type").isin(*SETTINGS["episodic"]) & (F.coalesce("source_kind", F.lit("")) != "derived_from_file"))
    return rows.select("id", "type", "salience").orderBy("salience", "id").limit(50)


def digest_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six decisions and four open questions of the greatest salience."""
    kind = F.when(F.col("type").isin(*config.RULING_TYPES), "decision").when(F.col("type") == "open_question", "question")
    rows = _valued(spark, sf_dir).withColumn("kind", kind).where("kind is not null").where(F.coalesce("status", F.lit("active")).isin("active", "captured"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("salience"), "id"))
    return rows.withColumn("rank", rank).where("(kind = 'decision' and rank <= 6) or (kind = 'question' and rank <= 4)").select("kind", "rank", "id", "salience")


def _disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the graph, and pairs judged different as the conflict edges that consolidation writes for them."""
    pairs = table(spark, sf_dir, "duplicate_pairs").where("verdict = 'different' and a is not null and b is not null").distinct()
    rel = F.when(F.length("a") % 2 == 0, "contradicts").otherwise("supersedes")
    made = pairs.select(F.col("a").alias("src"), F.lit(1000).alias("pos"), rel.alias("rel"), F.col("b").alias("dst")).distinct()
    return edges(table(spark, sf_dir, "nodes")).select("src", "pos", "rel", "dst").unionByName(made)


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes linked by a conflict edge, with what each side weighs."""
    nodes = table(spark, sf_dir, "nodes")
    pairs = upkeep.contradiction_pairs(_disputed(spark, sf_dir), vertices(nodes))
    info = vertices(nodes, "type", "status", "confidence", "updated", "provenance", "verification")
    info = info.select("id", ops.source_rank(F.col("type"), F.col("provenance.kind")).alias("rank"), "confidence", F.coalesce("status", F.lit("active")).alias("status"), "updated", F.col("verification.status").alias("verified"))
    for end in ("a", "b"):
        pairs = pairs.join(info.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("rank", "confidence", "status", "updated", "verified")]), end)
    return pairs


def source_contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lost to their live source: those that verification finds contradicted, or found so before."""
    lost = verify_claims(spark, sf_dir).where("verdict = 'contradicted'").select("id")
    rows = vertices(table(spark, sf_dir, "nodes"), "type", "summary", "verification", "provenance").join(lost.withColumn("lost", F.lit(True)), "id", "left").where("lost or verification.status = 'contradicted'")
    return rows.select("id", ops.source_rank(F.col("type"), F.col("provenance.kind")).alias("rank"), F.substring(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")), 1, 200).alias("summary"))


def merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after merging confirmed duplicates; rulings and central nodes are never dropped."""
    merges = table(spark, sf_dir, "duplicate_pairs").where("verdict = 'same' and a <> b").select(F.least("a", "b").alias("keep_id"), F.greatest("a", "b").alias("drop_id"))
    return ops.survivors(merges, protected_nodes(spark, sf_dir))


def apply_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extraction of a unit taken as an item that restates its node's summary by its first line."""
    units = table(spark, sf_dir, "units").where("text is not null")
    items = units.select(F.col("extracted_at").alias("seq"), "id", F.when(F.col("kind") == "section", F.col("kind")).alias("type"), F.regexp_extract("text", r"[^\s][^\r\n]*", 0).alias("summary"), "content_sha", F.lit(None).cast("double").alias("confidence")).distinct()
    return ops.applied_items(items, vertices(table(spark, sf_dir, "nodes"), "source_hash", "summary", "confidence"))


def note_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authored nodes captured again: equal notes become one, with the tags of all."""
    rows = vertices(table(spark, sf_dir, "nodes"), "type", "summary", "body", "tags", "source_kind").where("source_kind = 'authored'")
    return upkeep.captured(rows).withColumn("tags", F.array_join("tags", ","))


def schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes as an older schema had them (derived hubs, names of grammar rules, no origins, trust fields missing), migrated."""
    one = vertices(table(spark, sf_dir, "nodes"), "type", "source_kind", "edges", "provenance", "verification")
    kinds = F.when(F.col("type").isin(*config.HUB_TYPES), "derived").when(F.col("type") == "function", "method_declaration").when(F.col("type") == "class", "impl_item").otherwise(F.col("type"))
    old = one.withColumn("type", kinds).withColumn("source_kind", F.when(F.col("source_kind") == "synthesized", "derived").otherwise(F.col("source_kind")))
    old = old.withColumn("edges", F.transform("edges", lambda e: F.when(e.isNotNull(), e.withField("origin", F.lit(None).cast("string")))))
    old = old.withColumn("provenance", F.when(F.length("id") % 3 != 0, F.col("provenance"))).withColumn("verification", F.when(F.length("id") % 2 != 0, F.col("verification")))
    new = upkeep.migrated(old)
    return new.select("id", "type", "source_kind", F.array_join(F.transform("edges", lambda e: e["origin"]), ",").alias("origins"), F.col("provenance.kind").alias("provenance"), F.col("verification.status").alias("verified"))


def _gold(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """Each case's best seed and the nodes linked to it."""
    best = small_side(seeds.groupBy("case_id").agg(F.max_by("id", F.struct(F.round("score", 9), "id")).alias("id")), "best")
    near = arcs.join(best.select("case_id", F.col("id").alias("u")), "u").select("case_id", F.col("v").alias("id"))
    return best.unionByName(near).distinct()


def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case, with K the number of gold nodes: recall at K by activation and by words alone, recall of the pack, and recall of the gold that words alone miss."""
    # One retrieval gives seeds, masses and pack.
    found = retrieve(table(spark, sf_dir, "nodes"), _asked(spark), _exact())
    seeds = found["seeds"]
    gold = materialize(_gold(seeds, found["conductance"]), "gold")
    k = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"))
    ranked = lambda df, c: df.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.round(c, 9)), "id"))).select("case_id", "id", "r")
    by_mass, by_words = ranked(found["masses"], "mass"), ranked(seeds, "score")
    rows = gold.join(k, "case_id").join(by_mass.withColumnRenamed("r", "rm"), ["case_id", "id"], "left").join(by_words.withColumnRenamed("r", "rw"), ["case_id", "id"], "left")
    rows = rows.join(found["pack"].select("case_id", "id", F.lit(True).alias("packed")), ["case_id", "id"], "left")
    top, known = F.coalesce(F.col("rm") <= F.col("k"), F.lit(False)), F.coalesce(F.col("rw") <= F.col("k"), F.lit(False))
    share = lambda c: F.round(F.count_if(c) / F.first("k"), 6)
    return rows.groupBy("case_id").agg(
        F.first("k").alias("k"), share(top).alias("recall"), share(known).alias("word_recall"), share(F.col("packed").isNotNull()).alias("pack_recall"),
        F.round(F.count_if(top & ~known) / F.nullif(F.count_if(~known), F.lit(0)), 6).alias("hop_recall"),
    )


def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means over the cases; a case without gold beyond its words has no part in hop recall."""
    return eval_recall(spark, sf_dir).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "word_recall", "pack_recall", "hop_recall")], F.count(F.lit(1)).alias("cases"))


def pattern_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nodes that others exemplify: how many of the links a review does not confirm (here those from ids of a length that four divides), and whether most instances are out of date."""
    nodes = table(spark, sf_dir, "nodes")
    e = edges(nodes)
    return upkeep.pattern_links(e, vertices(nodes, "status"), e.where("rel = 'exemplifies' and length(src) % 4 <> 0"))


def transfer_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per confirmed instance: how much of its pattern and the pattern's other instances the pack of its own summary holds."""
    nodes = table(spark, sf_dir, "nodes")
    right = materialize(resolved(edges(nodes).where("rel = 'exemplifies' and length(src) % 4 <> 0"), vertices(nodes)).select("src", "dst").distinct(), "confirmed")
    gold = right.select(F.col("src").alias("case_id"), F.col("dst").alias("id")).unionByName(right.alias("x").join(right.select(F.col("src").alias("id"), "dst"), "dst").where("id <> src").select(F.col("src").alias("case_id"), "id")).distinct()
    asked = vertices(nodes, "summary").join(right.select(F.col("src").alias("id")).distinct(), "id").select(F.col("id").alias("case_id"), F.coalesce(F.nullif(F.trim("summary"), F.lit("")), "id").alias("query"))
    packed = held(nodes, asked, gold, _exact()).withColumn("p", F.lit(True))
    return gold.join(packed, ["case_id", "id"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("gold"), F.round(F.count("p") / F.count(F.lit(1)), 3).alias("recall"))


def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of merging: pack recall and pack hop recall on the graph and on it with the confirmed duplicates merged, the gold of both taken from the graph before."""
    nodes = table(spark, sf_dir, "nodes")
    ids = vertices(nodes)
    merges = table(spark, sf_dir, "duplicate_pairs").where("verdict = 'same' and a <> b").select(F.least("a", "b").alias("keep_id"), F.greatest("a", "b").alias("drop_id"))
    for end in ("keep_id", "drop_id"):
        merges = merges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    moves = materialize(ops.survivors(merges, protected_nodes(spark, sf_dir)).select(F.col("drop_id").alias("old"), F.col("survivor").alias("new")), "moves")
    after = materialize(merged_nodes(nodes, moves), "merged")
    before = retrieve(nodes, _asked(spark), _exact())
    seeds = before["seeds"]
    gold = materialize(_gold(seeds, before["conductance"]), "gold")
    words = seeds.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.round("score", 9)), "id")))
    k = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"))
    frozen = gold.join(k, "case_id").join(words.select("case_id", "id", "r"), ["case_id", "id"], "left").select("case_id", "id", (~F.coalesce(F.col("r") <= F.col("k"), F.lit(False))).alias("hop"))
    packed = retrieve(after, _asked(spark), _exact())["pack"]
    out = ops.gate(frozen, before["pack"], packed, SETTINGS["eval_drop"])
    return out.select("case_id", "k", "hop_gold", *[F.round(c, 6).alias(c) for c in ("recall_before", "recall_after", "hop_recall_before", "hop_recall_after")], "lost", "recall_delta", "hop_recall_delta", "status")


def membership_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of topics: a slug with the beginning of the topic's hash."""
    topics = memberships(table(spark, sf_dir, "nodes")).select("topic").distinct()
    return topics.select("topic", F.concat(slug(F.translate("topic", "/:", "  ")), F.lit("-"), F.substring(F.sha2("topic", 256), 1, 8)).alias("file"))


QUERIES = {
    f.__name__: f
    for f in (
        cosine_candidates, lexical_candidates, near_duplicates, link_pairs, link_batches, judged_batches, usage_pairs, usage_attribution, coactivation_counts, fold_weights, salience_rank, digest_top, contradictions, source_contradicted,
        merge_actions, apply_items, note_ids, schema_migration, eval_recall, eval_means, pattern_metrics, transfer_recall, eval_gate, membership_slugs,
    )
}

_G = f"with recursive {GRAPH}"
_RES = "re as (select * from ed where dst in (select id from vx))"
_DEG = "dg as (select id, count(x) degree from vx left join (select unnest([src, dst]) x from re) on x = id group by id)"
_EPI = "coalesce(source_kind, '') <> 'derived_from_file' and type in ('section', 'note', 'open_question', 'plan')"
_TOK = r"list_distinct(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)))"
_RANK = "case when lower(type) in ('adr', 'decision') then 4 else case lower(provenance.kind) when 'code' then 6 when 'doc' then 5 when 'data' then 5 when 'user' then 5 when 'chat' then 3 when 'model_inference' then 1 else 2 end end"
_SAL = f"""ow as (select src, sum(coalesce(coact, 0)) coact, bool_or(coalesce(rel in ('documents', 'implements', 'specifies'), false)) o from ed group by 1),
gr as (select distinct dst from re where rel in ('documents', 'implements', 'specifies')),
va as (select vx.*, round(0.3 * case when lower(type) in ('decision', 'adr') then 1.0 else 0.4 end
 + 0.2 * coalesce(greatest(0, 1 - (epoch('{NOW}'::timestamp) - epoch(try_strptime(substr(updated, 1, 19), '%Y-%m-%dT%H:%M:%S'))) / 86400.0 / 120), 0.5) + 0.2 * least(1.0, coalesce(coact, 0) / 10.0)
 + 0.2 * degree / (select greatest(max(degree), 1) from dg) + 0.1 * case when coalesce(source_kind, '') = 'derived_from_file' or gr.dst is not null or coalesce(o, false) then 1.0 else 0.4 end, 3) salience
 from vx join dg using (id) left join ow on ow.src = vx.id left join gr on gr.dst = vx.id)"""
_COACT = "select least(source, target) a, greatest(source, target) b, count(*) n from links where coact > 0 and target is not null and source <> target group by 1, 2"
_PROT = "pr as (select id from vx join dg using (id) where lower(type) in ('decision', 'adr') or degree / (select greatest(max(degree), 1) from dg) > 0.7)"
_SURV = """mg as (select drop_id, min(keep_id) keep_id from (select least(a, b) keep_id, greatest(a, b) drop_id from duplicate_pairs where verdict = 'same' and a <> b) where drop_id not in (from pr) group by 1),
wk as (select drop_id, keep_id cur from mg union all select wk.drop_id, mg.keep_id from wk join mg on mg.drop_id = wk.cur),
sv as (select drop_id, cur survivor from wk where cur not in (select drop_id from mg))"""
_EVAL = (
    BASE
    + _ppr(_START)
    + _active()
    + _packed()
    + """, be as (select case_id, max(row(round(score, 9), id))[2] id from sc group by 1), gd as (select case_id, id from be union select be.case_id, v from cd join be on be.id = cd.u),
kk as (select case_id, count(*) k from gd group by 1), bm as (select case_id, id, row_number() over (partition by case_id order by round(mass, 9) desc, id) rm from pi), bw as (select case_id, id, row_number() over (partition by case_id order by round(score, 9) desc, id) rw from sc),
ev as (select gd.case_id, k, coalesce(rm <= k, false) top, coalesce(rw <= k, false) known, po.id is not null packed from gd join kk using (case_id) left join bm on bm.case_id = gd.case_id and bm.id = gd.id left join bw on bw.case_id = gd.case_id and bw.id = gd.id
 left join po on po.case_id = gd.case_id and po.id = gd.id and (po.tier <> 'periphery' or ord <= 40)),
er as (select case_id, any_value(k) k, round(count(*) filter (top) / any_value(k), 6) recall, round(count(*) filter (known) / any_value(k), 6) word_recall, round(count(*) filter (packed) / any_value(k), 6) pack_recall,
 round(count(*) filter (top and not known) / nullif(count(*) filter (not known), 0), 6) hop_recall from ev group by 1)"""
)

_NSLUG = r"regexp_replace(substr(regexp_replace(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '^-+|-+$', '', 'g')"
_DIS = """dd as (select src, pos, rel, dst from ed union all select distinct a, 1000, case when length(a) % 2 = 0 then 'contradicts' else 'supersedes' end, b from duplicate_pairs where verdict = 'different' and a is not null and b is not null)"""

SQL = {
    "cosine_candidates": """with u as (select vec_id id, embedding::double[] v from embeddings), p as (select a.id, b.id other, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) sim from u a join u b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by sim desc, other desc) rank from p where sim >= 0.35) select id, other, cast(rank as integer) rank, round(sim, 6) sim from r where rank <= 5""",
    "lexical_candidates": rf"""{_G},{SEEDS}, lp as (select distinct least(x, y) a, greatest(x, y) b from (select src x, dst y from ed union all select a, b from duplicate_pairs where verdict is not null) where x is not null and y is not null and x <> y),
d as (select id, list_distinct(ws) ws, coalesce(bucket, '?') g, coalesce(source_path, '') f from tx join vx using (id) where trim(coalesce(summary, '')) <> '' and coalesce(status, 'active') <> 'stale'),
t as (select id, w from (select id, unnest(ws) w from d) where length(w) >= 3), ok as (select w from t group by 1 having count(*) <= greatest(4, (select count(*) from d) // 4)),
p as (select x.id a, y.id b, count(*) shared from t x join t y on x.w = y.w and x.id < y.id where x.w in (from ok) group by 1, 2 having count(*) >= 2),
q as (select p.a, p.b, printf('%.4f', shared / len(list_distinct(list_filter(x.ws || y.ws, lambda w: length(w) >= 3))))::double sim from p join d x on x.id = a join d y on y.id = b anti join lp on lp.a = p.a and lp.b = p.b where x.g <> y.g or (x.f <> y.f and x.f <> '' and y.f <> '')),
r as (select *, row_number() over (partition by id order by sim desc, other) rank from (select a id, b other, sim from q union all select b, a, sim from q)) select id, other, cast(rank as integer) rank, sim from r where rank <= 5""",
    "near_duplicates": f"""{_G}, d as (select id, {_TOK.format("coalesce(summary, '') || ' ' || substr(coalesce(body, ''), 1, 400)")} ws from vx where {_EPI}), t as (select id, unnest(ws) w from d),
p as (select x.id a, y.id b, count(*) i from t x join t y on x.w = y.w and x.id < y.id group by 1, 2)
select a, b, round(i / (len(x.ws) + len(y.ws) - i), 6) sim from p join d x on x.id = a join d y on y.id = b where i / (len(x.ws) + len(y.ws) - i) >= 0.82""",
    "link_pairs": f"{_G} select distinct least(x, y) a, greatest(x, y) b from (select src x, dst y from ed union all select a, b from duplicate_pairs where verdict is not null) where x is not null and y is not null and x <> y",
    "link_batches": f"{_G} select id, cast((row_number() over (order by id) - 1) // 80 as integer) batch from vx where trim(coalesce(summary, '')) <> '' and coalesce(status, 'active') <> 'stale'",
    "judged_batches": f"""{_G}, b as (select id, (row_number() over (order by id) - 1) // 4 batch from vx where type in ('note', 'decision', 'adr')), j as (select distinct unnest([a, b]) id from duplicate_pairs where verdict is not null)
select cast(batch as integer) batch, count(*) nodes, count(j.id) judged, count(*) = count(j.id) retired from b left join j using (id) group by 1""",
    "usage_pairs": """with s as (select distinct concat_ws('/', user_id, ts::date) session, case event_type when 'purchase' then 'accepted' when 'error' then 'reverted' end outcome, cast(props->>'$.k' as integer) item from events)
select distinct x.outcome, x.item a, y.item b from s x join s y on x.session = y.session and x.outcome = y.outcome and x.item < y.item""",
    "usage_attribution": BASE
    + _ppr(_START)
    + _active()
    + _packed()
    + r""", sn as (select snap_no, id, source_path, taken_at, regexp_replace(regexp_replace(lower(regexp_replace(content_sha, '^\s+|\s+$', '', 'g')), '^sha256:', ''), '^\s+|\s+$', '', 'g') h from unit_snapshots
  where id is not null and snap_no in (select distinct snap_no from unit_snapshots where id is not null and snap_no is not null order by 1 desc limit 2)),
hs as (select snap_no, id, h from sn qualify row_number() over (partition by snap_no, id order by taken_at desc nulls last, h desc nulls last) = 1),
ch as (select id from hs where (select count(distinct snap_no) from hs) = 2 group by id having count(*) = 1 or min(h) is distinct from max(h) or count(h) = 1)
select po.case_id, po.id, vx.source_path from po join vx using (id) where (po.tier <> 'periphery' or ord <= 40) and vx.source_path in (select source_path from sn where id in (from ch) and source_path <> '')""",
    "coactivation_counts": _COACT,
    "fold_weights": f"""{_G}, c as ({_COACT}), j as (select distinct least(a, b) a, greatest(a, b) b, verdict from duplicate_pairs where a is not null and b is not null),
x as (select src, rel, dst, coalesce(w, 0.5) w, coalesce(coact, 0) + coalesce(n, 0) coact, n, u.a is not null up, d.a is not null dn from ed left join c on c.a = least(src, dst) and c.b = greatest(src, dst)
 left join j u on u.verdict = 'same' and u.a = least(src, dst) and u.b = greatest(src, dst) left join j d on d.verdict = 'different' and d.a = least(src, dst) and d.b = greatest(src, dst)),
y as (select *, case when up then w + 0.1 * (1 - w) else w end w1 from x), z as (select *, case when dn then w1 - 0.1 * w1 else w1 end w2 from y),
f as (select src, rel, dst, coact, round(greatest(0, least(1, case when n is not null and not up and not dn then w2 - 0.02 else w2 end)), 4) w from z) select src, rel, dst, round(w, 6) w, cast(coact as bigint) coact from f where w >= 0.05""",
    "salience_rank": f"{_G}, {_RES}, {_DEG}, {_SAL} select id, type, salience from va where {_EPI} order by salience, id limit 50",
    "digest_top": f"""{_G}, {_RES}, {_DEG}, {_SAL}, k as (select *, case when type in ('decision', 'adr') then 'decision' when type = 'open_question' then 'question' end kind from va where coalesce(status, 'active') in ('active', 'captured')),
r as (select *, row_number() over (partition by kind order by salience desc, id) rank from k where kind is not null) select kind, cast(rank as integer) rank, id, salience from r where rank <= case kind when 'decision' then 6 else 4 end""",
    "contradictions": f"""{_G}, {_DIS}, p as (select least(src, dst) a, greatest(src, dst) b, arg_min(rel, row(src, pos, rel)) rel from dd where rel in ('contradicts', 'supersedes') and src <> dst and dst in (select id from vx) group by 1, 2),
i as (select id, {_RANK} as rank, confidence, coalesce(status, 'active') status, updated, verification.status verified from vx)
select a, b, rel, x.rank rank_a, y.rank rank_b, x.confidence confidence_a, y.confidence confidence_b, x.status status_a, y.status status_b, x.updated updated_a, y.updated updated_b, x.verified verified_a, y.verified verified_b from p join i x on x.id = a join i y on y.id = b""",
    "source_contradicted": rf"""{_G}, {_U}, {_F}, ct as (select fn.id from fn left join un on un.id = fn.id where fn.source_path not in (select source_path from un where source_path is not null) or fn.source_path is null or un.id is null)
select id, {_RANK} as rank, substr(trim(regexp_replace(coalesce(summary, ''), '\s+', ' ', 'g')), 1, 200) summary from vx where verification.status = 'contradicted' or id in (from ct)""",
    "merge_actions": f"{_G}, {_RES}, {_DEG}, {_PROT}, {_SURV} select drop_id, survivor from sv",
    "apply_items": rf"""{_G}, it as (select distinct extracted_at seq, id, case when kind = 'section' then kind end as type, regexp_extract(text, '[^\s][^\r\n]*', 0) summary, content_sha from units where text is not null and id is not null),
o as (select it.*, vx.summary old, vx.confidence sure, case when vx.id is null then case when it.type is not null then 'created' else 'skipped_missing' end when it.content_sha is not null and it.content_sha is distinct from vx.source_hash then 'skipped_stale' else 'updated' end outcome from it left join vx using (id))
select id, outcome, count(*) items, coalesce(arg_max(summary, row(seq, summary)) filter (outcome not like 'skipped%'), max(old)) summary, greatest(0, least(1, coalesce(max(sure), 0.7))) confidence from o group by 1, 2""",
    "note_ids": rf"""{_G}, n as (select id, type, summary, coalesce(body, '') body, list_filter(coalesce(tags, []), lambda x: x is not null) tags from vx where source_kind = 'authored' and trim(coalesce(summary, '')) <> ''),
k as (select *, 'note:' || coalesce(nullif({_NSLUG.format("summary")}, ''), nullif({_NSLUG.format("tags[1]")}, ''), 'note') || '-' || substr(sha256(coalesce(type, '') || chr(10) || summary || chr(10) || body || chr(10) || array_to_string(list_sort(tags), ',')), 1, 8) note_id from n),
g as (select note_id, min(id) id, arg_min(summary, id) summary, arg_min(type, id) ty, coalesce(array_to_string(list_sort(list_distinct(flatten(list(tags)))), ','), '') tags, count(*) notes from k group by 1)
select note_id, id, summary, tags, case when ty in ('decision', 'adr') then 'user' else 'model_inference' end kind, case when ty in ('decision', 'adr') then 'verified' else 'unverified' end verified, notes from g""",
    "schema_migration": rf"""{_G} select id, case when type in ('hub', 'overview') then case when contains(lower(regexp_replace(id, '^[^:]*:', '')), 'overview') then 'overview' else 'hub' end else type end as type, source_kind,
array_to_string(list_transform(edges, lambda e: case when e is null then null when coalesce(e.rel in ('imports', 'calls'), false) then 'structural' when coalesce(source_kind, '') = 'synthesized' then 'synthesized' else 'semantic' end), ',') origins,
coalesce(case when length(id) % 3 <> 0 and provenance is not null then provenance.kind end, case when length(id) % 3 <> 0 and provenance is not null then null when source_kind = 'authored' then case when lower(type) in ('decision', 'adr') then 'user' else 'model_inference' end when source_kind = 'synthesized' then 'model_inference'
 else case when split_part(id, ':', 1) in ('code', 'doc', 'data') then split_part(id, ':', 1) else 'doc' end end) provenance, case when length(id) % 2 <> 0 and verification is not null then verification.status else 'unverified' end verified from vx""",
    "eval_recall": _EVAL + " select case_id, k, recall, word_recall, pack_recall, hop_recall from er",
    "eval_means": _EVAL + " select round(avg(recall), 6) recall, round(avg(word_recall), 6) word_recall, round(avg(pack_recall), 6) pack_recall, round(avg(hop_recall), 6) hop_recall, count(*) cases from er",
    "pattern_metrics": f"""{_G}, {_RES}, e as (select distinct src, dst from re where rel = 'exemplifies')
select dst pattern_id, count(*) instances, count(*) filter (length(src) % 4 = 0) false_links, round(count(*) filter (length(src) % 4 = 0) / count(*), 3) false_analogy_rate, count(*) filter (coalesce(status, 'active') <> 'active') * 2 > count(*) stale from e join vx on id = src group by 1""",
    "membership_slugs": rf"{_G} select topic, substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(translate(topic, '/:', '  '))), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) || '-' || substr(sha256(topic), 1, 8) file from (select distinct topic from mb)",
}
