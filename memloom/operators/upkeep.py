"""Upkeep of a graph: contradictions, gaps, audits, migration, notes, judged batches, moves and repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memloom.operators.graph import dangling, resolved
from memloom.operators.skew import skew_join
from memloom.plans import config

# Folders of id prefixes, old names of definition kinds, marks of an unfinished merge.
BUCKETS = ("code", "doc", "data")
OLD_KINDS = {
    "function_definition": "function", "function_declaration": "function", "method_definition": "function", "method_declaration": "function", "function_item": "function", "constructor_declaration": "function",
    "class_definition": "class", "class_declaration": "class", "class_specifier": "class", "struct_specifier": "class", "struct_item": "class", "impl_item": "class", "trait_item": "class", "interface_declaration": "class", "enum_declaration": "class",
}
CONFLICT = r"(?m)^(<<<<<<<|\|\|\|\|\|\|\||>>>>>>>)( |$)"


def category(ident: Column) -> Column:
    return F.regexp_extract(ident, r"^([^:]*):", 1)


def contradiction_pairs(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, rel): the unordered pairs of nodes that a conflict edge links; of several edges the rel of the first by (src, pos)."""
    e = resolved(edges.where(F.col("rel").isin(*config.CONFLICT_RELS) & (F.col("src") != F.col("dst"))), ids)
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by("rel", F.struct("src", "pos", "rel")).alias("rel"))


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, target) of what synthesis lacks: ``undocumented`` code that is not stale and that nothing documents, ``drifted`` documents edges of doc nodes to absent nodes, ``conflict`` edges between nodes.

    ``nodes``: (id, status). All rows are given.
    """
    ids = nodes.select("id")
    said = edges.where("rel = 'documents'")
    told = resolved(said, ids).select(F.col("dst").alias("id")).distinct()
    code = nodes.where((category(F.col("id")) == "code") & (F.coalesce("status", F.lit("active")) != "stale")).join(told, "id", "left_anti")
    drifted = dangling(said.where(category(F.col("src")) == "doc"), ids).select(F.lit("drifted").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("target"))
    conflicts = resolved(edges.where(F.col("rel").isin(*config.CONFLICT_RELS)), ids).select(F.lit("conflict").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("target"))
    return code.select(F.lit("undocumented").alias("kind"), "id", F.lit(None).cast("string").alias("target")).unionByName(drifted).unionByName(conflicts)


def audit(nodes: DataFrame, queue: DataFrame) -> DataFrame:
    """(anomaly, id): every node that breaks an invariant, by the eight anomalies.

    unparsable (rows without an id, id null), duplicate_ids (an id in rows that differ or repeat), path_mismatch (the bucket is not the one the id and source kind call for), bad_shape (an edge without target or rel),
    status_inconsistent (a file node that is active though its derivation lags, or stale though it does not), missing_trust_fields (a file node without verification or provenance), queue_lag (``queue`` (id) holds an id that is no node or no longer
    stale), conflict_markers (a text with marks of an unfinished merge).
    """
    known = nodes.where("id is not null")
    one = known.dropDuplicates(["id"])
    home = F.when(F.coalesce("source_kind", F.lit("")) == "synthesized", "_hubs").when(category(F.col("id")).isin(*BUCKETS), category(F.col("id"))).otherwise("notes")
    filed = (F.col("source_kind") == "derived_from_file") & F.col("source_hash").isNotNull()
    lags = ~F.col("derived_from_hash").eqNullSafe(F.col("source_hash"))
    status = F.coalesce("status", F.lit("active"))
    queued = queue.select("id").distinct().join(one.select("id", status.alias("s")), "id", "left").where("s is null or s <> 'stale'")
    odd_edge = F.exists(F.coalesce("edges", F.array().cast(dict(nodes.dtypes)["edges"])), lambda e: e.isNull() | (F.coalesce(e["to"], F.lit("")) == "") | (F.coalesce(e["rel"], F.lit("")) == ""))
    found = {
        "unparsable": nodes.where("id is null").select("id"),
        "duplicate_ids": known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "path_mismatch": one.where(~F.col("bucket").eqNullSafe(home)),
        "bad_shape": one.where(odd_edge),
        "status_inconsistent": one.where(filed & (((status == "active") & lags) | ((status == "stale") & ~lags))),
        "missing_trust_fields": one.where((F.col("source_kind") == "derived_from_file") & (F.col("verification").isNull() | F.col("provenance").isNull())),
        "queue_lag": queued,
        "conflict_markers": one.where(F.concat_ws("\n", "summary", "body").rlike(CONFLICT)),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("anomaly"), "id") for k, df in found.items()])


def migrated(nodes: DataFrame) -> DataFrame:
    """``nodes`` brought to the present schema: source kind ``derived`` is ``synthesized``, type ``derived`` a hub or overview, old definition kinds functions and classes; edges without origin, nodes without provenance or verification get one. Running it again changes nothing."""
    kind = F.when(F.col("source_kind") == "derived", "synthesized").otherwise(F.col("source_kind"))
    old = F.create_map(*[F.lit(x) for p in OLD_KINDS.items() for x in p])
    tail = F.lower(F.regexp_replace("id", r"^[^:]*:", ""))
    type_ = F.when(F.col("type") == "derived", F.when(tail.contains("overview"), "overview").otherwise("hub")).otherwise(F.coalesce(F.element_at(old, F.col("type")), F.col("type")))
    rows = nodes.withColumn("source_kind", kind).withColumn("type", type_)
    origin = lambda e: F.when(F.coalesce(e["origin"], F.lit("")) != "", e["origin"]).when(F.coalesce(e["rel"].isin("imports", "calls"), F.lit(False)), "structural").when(F.coalesce("source_kind", F.lit("")) == "synthesized", "synthesized").otherwise("semantic")
    rows = rows.withColumn("edges", F.transform("edges", lambda e: F.when(e.isNotNull(), e.withField("origin", origin(e)))))
    prefix = category(F.col("id"))
    who = (
        F.when(F.col("source_kind") == "authored", F.when(F.lower("type").isin(*config.RULING_TYPES), "user").otherwise("model_inference"))
        .when(F.col("source_kind") == "synthesized", "model_inference").otherwise(F.when(prefix.isin(*BUCKETS), prefix).otherwise("doc"))
    )
    types = dict(nodes.dtypes)
    blank = lambda c, **given: F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in given.items()])), types[c])
    rows = rows.withColumn("provenance", F.coalesce("provenance", blank("provenance", kind=who)))
    return rows.withColumn("verification", F.coalesce("verification", blank("verification", status=F.lit("unverified"), method=F.lit("none"))))


def note_slug(text: Column) -> Column:
    words = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, 40), "^-+|-+$", "")


def captured(notes: DataFrame) -> DataFrame:
    """(note_id, id, summary, tags, kind, verified, notes): ``notes`` (id, type, summary, body, tags) captured under ids made of their content.

    The id is a slug of the summary (else of the first tag, else ``note``) and a hash of type, summary, body and sorted tags, so a note captured again is the same note: its tags accumulate in the order of ``id``. Rulings are the user's and verified,
    the rest inferred and unverified. Notes with a blank summary are not captured.
    """
    tags = F.coalesce(F.array_compact("tags"), F.array().cast("array<string>"))
    said = notes.where("trim(coalesce(summary, '')) <> ''").select("id", "type", "summary", F.coalesce("body", F.lit("")).alias("body"), tags.alias("tags"))
    slug = F.coalesce(F.nullif(note_slug(F.col("summary")), F.lit("")), F.nullif(note_slug(F.try_element_at("tags", F.lit(1))), F.lit("")), F.lit("note"))
    digest = F.substring(F.sha2(F.concat_ws("\n", F.coalesce("type", F.lit("")), "summary", "body", F.array_join(F.array_sort("tags"), ",")), 256), 1, 8)
    rows = said.withColumn("note_id", F.concat(F.lit("note:"), slug, F.lit("-"), digest))
    out = rows.groupBy("note_id").agg(F.min("id").alias("id"), F.min_by("summary", "id").alias("summary"), F.min_by("type", "id").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.count(F.lit(1)).alias("notes"))
    user = F.coalesce(F.col("type").isin(*config.RULING_TYPES), F.lit(False))
    return out.select("note_id", "id", "summary", "tags", F.when(user, "user").otherwise("model_inference").alias("kind"), F.when(user, "verified").otherwise("unverified").alias("verified"), "notes")


def retired_batches(batches: DataFrame, judged: DataFrame) -> DataFrame:
    """(batch, nodes, judged, retired): a batch (id, batch) retires when the ``judged`` ids (id) cover all its nodes."""
    rows = batches.join(judged.select("id").distinct().withColumn("j", F.lit(True)), "id", "left")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("nodes"), F.count("j").alias("judged"), (F.count("j") == F.count(F.lit(1))).alias("retired"))


def pattern_links(edges: DataFrame, nodes: DataFrame, correct: DataFrame) -> DataFrame:
    """(pattern_id, instances, false_links, false_analogy_rate, stale): the ``exemplifies`` edges to each pattern, how many of them are not among the ``correct`` (src, dst), and whether most of its instances are not active."""
    ex = resolved(edges.where("rel = 'exemplifies'"), nodes).select("src", "dst").distinct()
    ex = ex.join(correct.select("src", "dst").distinct().withColumn("right", F.lit(True)), ["src", "dst"], "left").join(nodes.select(F.col("id").alias("src"), "status"), "src")
    n = F.count(F.lit(1))
    return ex.groupBy(F.col("dst").alias("pattern_id")).agg(n.alias("instances"), (n - F.count("right")).alias("false_links"), F.round((n - F.count("right")) / n, 3).alias("false_analogy_rate"), (F.count_if(F.coalesce("status", F.lit("active")) != "active") * 2 > n).alias("stale"))


def bare_targets(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """(target, id): targets that are a bare symbol without a path, with the one node of the category whose qualname it is.

    Not where several nodes have it, nor where a file has that name. ``imports`` targets are the caller's to leave out: a name outside is legitimate there.
    """
    qual = ids.where(F.col("id").contains("::")).select("id", category(F.col("id")).alias("c"), F.regexp_extract("id", r"::(.*)$", 1).alias("name"))
    one = qual.groupBy("c", "name").agg(F.min("id").alias("id"), F.max("id").alias("_other")).where("id = _other").drop("_other")
    files = ids.where(~F.col("id").contains("::")).select(category(F.col("id")).alias("c"), F.element_at(F.split(F.regexp_replace("id", r"^[^:]*:", ""), "/"), -1).alias("name"), F.col("id").contains("/").alias("deep")).where("deep").select("c", "name").distinct()
    bare = targets.where(F.col("target").contains(":") & ~F.col("target").contains("::") & ~F.col("target").contains("/")).select("target", category(F.col("target")).alias("c"), F.regexp_replace("target", r"^[^:]*:", "").alias("name"))
    return bare.where("name <> ''").join(files, ["c", "name"], "left_anti").join(one, ["c", "name"]).select("target", "id")


def moved_nodes(nodes: DataFrame, moves: DataFrame, units: DataFrame) -> DataFrame:
    """(old_id, id, source_path, status, requeue, part_of, edges) of nodes whose unit moved. ``moves``: (old_id, new_id); ``units``: (id, source_path, category, content_sha, …).

    What was earned stays: summary, memberships and edges. Targets in the old file go to the same symbols of the new one, the membership in the old folder goes to the new folder (the first of equal topics counts), and a node
    whose derivation is not of the present content becomes stale and is to be derived again.
    """
    rows = nodes.select(F.col("id").alias("old_id"), F.col("source_path").alias("old_path"), "derived_from_hash", "status", "part_of", "edges").join(moves, "old_id")
    rows = rows.join(units.select(F.col("id").alias("new_id"), "source_path", "category", "content_sha"), "new_id")
    folder = lambda path, otherwise: F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(otherwise)
    old_home, new_home = folder(F.col("old_path"), F.col("category")), folder(F.col("source_path"), F.col("category"))
    head = F.concat(F.lit("code:"), "old_path")
    to = lambda t: F.when((t == head) | t.startswith(F.concat(head, F.lit("::"))), F.concat(F.lit("code:"), "source_path", F.substr(t, F.length(head) + 1))).otherwise(t)
    topics = F.transform(F.filter(F.coalesce("part_of", F.array().cast(dict(nodes.dtypes)["part_of"])), lambda p: F.coalesce(p["topic"], F.lit("")) != ""), lambda p: F.when(p["topic"] == F.col("old_home"), F.col("new_home")).otherwise(p["topic"]))
    rows = rows.withColumn("old_home", old_home).withColumn("new_home", new_home).withColumn("topics", F.array_distinct(topics))
    fresh = F.col("derived_from_hash").eqNullSafe(F.col("content_sha"))
    status = F.when(fresh, F.coalesce("status", F.lit("active"))).otherwise("stale")
    targets = F.transform(F.coalesce("edges", F.array().cast(dict(nodes.dtypes)["edges"])), lambda e: to(e["to"]))
    return rows.select("old_id", F.col("new_id").alias("id"), "source_path", status.alias("status"), (~fresh | (status == "stale")).alias("requeue"), F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array("new_home")).alias("topics"), targets.alias("targets"))


def commit_staleness(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, verdict) of file nodes with a path: ``stale`` if their file changed since their commit, ``current`` if not, ``unresolved`` if ``changes`` (commit, path) does not know the commit, ``no_commit``.

    A commit without changes has one row with a null path.
    """
    rows = nodes.where("source_kind = 'derived_from_file' and coalesce(source_path, '') <> ''").select("id", "source_path", F.col("provenance.commit").alias("commit"))
    known = changes.select("commit").distinct().withColumn("known", F.lit(True))
    hit = changes.where("path is not null").select("commit", F.col("path").alias("source_path")).distinct().withColumn("hit", F.lit(True))
    rows = skew_join(rows, known, ["commit"], "left").join(hit, ["commit", "source_path"], "left")
    return rows.select("id", F.when(F.coalesce("commit", F.lit("")) == "", "no_commit").when(F.col("known").isNull(), "unresolved").when(F.col("hit"), "stale").otherwise("current").alias("verdict"))


def coactivated(pack: DataFrame, steps: DataFrame) -> DataFrame:
    """(case_id, a, b): the pairs a < b of nodes of a case's pack, periphery left out, that are neighbours in the graph (u, v)."""
    inside = pack.where("tier <> 'periphery'").select("case_id", "id")
    out = steps.where("u < v").select("u", "v").join(inside.withColumnRenamed("id", "u"), "u").join(inside.withColumnRenamed("id", "v"), ["case_id", "v"])
    return out.select("case_id", F.col("u").alias("a"), F.col("v").alias("b")).distinct()


def fold_state(log: DataFrame) -> DataFrame:
    """(last, last_judged, folds) of an action log (ts, message): the last consolidation, the last judged pass, and the weight folds since."""
    own = log.where(F.col("message").startswith("consolidate |"))
    judged = F.col("message").contains("consolidation applied")
    seen = own.agg(F.max("ts").alias("last"), F.max(F.when(judged, F.col("ts"))).alias("last_judged"))
    folds = own.crossJoin(F.broadcast(seen)).where(F.col("message").contains("weights folded") & (F.col("last_judged").isNull() | (F.col("ts") > F.col("last_judged")))).agg(F.count(F.lit(1)).alias("folds"))
    return seen.crossJoin(folds)
