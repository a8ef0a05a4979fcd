"""Extraction and reconciliation over units: diffs, moves, symbol resolution, target repair and work queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from memloom.functions.text import subtree
from memloom.operators.ordering import global_positions, partition_offsets, sorted_with_local_rows
from memloom.operators.skew import skew_join
from memloom.session import materialize


def newest_units(units: DataFrame) -> DataFrame:
    """One row per unit id, the one extracted last (then the greatest hash): repeated and late rows do not count. Null ids are dropped."""
    last = Window.partitionBy("id").orderBy(F.desc_nulls_last("extracted_at"), F.desc_nulls_last("content_sha"))
    return units.where("id is not null").withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def diff_classes(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, change): added, changed, frozen, lagging, unchanged, deleted or kept, by a full outer join of fresh units with the nodes made from files.

    A node of policy ``absorb_once`` is frozen whatever its file says; a node whose unit is gone is deleted only under policy ``mirror``; an unchanged
    unit lags if its node was derived from another hash or is stale.
    """
    u = units.select("id", F.col("content_sha").alias("new"), F.lit(True).alias("fresh"))
    n = nodes.select("id", F.col("source_hash").alias("old"), "derived_from_hash", "status", "policy", F.lit(True).alias("known"))
    kind = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("fresh").isNull(), F.when(F.col("policy") == "mirror", "deleted").otherwise("kept"))
        .when(F.col("policy") == "absorb_once", "frozen")
        .when(~F.col("new").eqNullSafe(F.col("old")), "changed")
        .when(~F.col("derived_from_hash").eqNullSafe(F.col("old")) | (F.col("status") == "stale"), "lagging")
        .otherwise("unchanged")
    )
    return u.join(n, "id", "full_outer").select("id", kind.alias("change"))


def paired_moves(gone: DataFrame, come: DataFrame) -> DataFrame:
    """(old_id, new_id): the k-th vanished with the k-th new id of equal content hash, both in the order of ids. Null hashes pair nothing.

    Numbered by a range-partitioned sort: the files of one text, a licence say, may be many.
    """

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        at = global_positions(rows.where("sha is not null and id is not null").select("sha", F.col("id").alias(name)), [F.col("sha"), F.col(name)], "at", "moves")
        at = materialize(at, "numbered")
        return skew_join(at, at.groupBy("sha").agg(F.min("at").alias("first")), ["sha"]).select("sha", name, (F.col("at") - F.col("first")).alias("k"))

    return numbered(gone, "old_id").join(numbered(come, "new_id"), ["sha", "k"]).select("old_id", "new_id")


def dotted(path: Column) -> Column:
    """A module's dotted name: its path without extension, a package's ``__init__`` left out."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/", "."), r"\.__init__$", "")


def module_names(modules: DataFrame) -> DataFrame:
    """(name, path): every suffix of a module's dotted name that belongs to one module only. ``modules``: (path)."""
    parts = F.split(dotted(F.col("path")), r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return modules.select("path", suffix.alias("name")).groupBy("name").agg(F.min("path").alias("path"), F.max("path").alias("_other")).where("path = _other").drop("_other")


def longest_module(written: DataFrame, names: DataFrame) -> DataFrame:
    """(written, path, rest): the longest dotted prefix of each written name that names a module, and what follows it.

    The prefixes are exploded and joined on equality; the longest wins outright, whatever the rest.
    """
    parts = F.split("written", r"\.")
    each = written.select("written").distinct().select("written", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).select("written", "n", F.array_join(F.slice(F.split("written", r"\."), F.lit(1), F.col("n")), ".").alias("name"))
    best = each.join(names, "name").groupBy("written").agg(F.max(F.struct("n", "path")).alias("b"))
    return best.select("written", F.col("b.path").alias("path"), F.array_join(F.slice(F.split("written", r"\."), F.col("b.n") + 1, F.size(F.split("written", r"\."))), ".").alias("rest"))


def repaired_targets(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """(target, id): the one node whose path ends with the path written in ``targets``, in the same category and with the same qualname.

    Every proper suffix of every node path becomes a key, so the suffix test is an equality join; a target with more than one fit stays unrepaired.
    """
    cut = lambda c: (F.regexp_extract(c, r"^([^:]*):", 1), F.regexp_replace(F.regexp_replace(c, r"^[^:]*:", ""), r"::.*$", ""), F.when(F.locate("::", c) > 0, F.regexp_replace(c, r"^.*?::", "")).otherwise(""))
    category, path, qual = cut(F.col("id"))
    parts = F.split("path", "/")
    have = ids.select("id", category.alias("category"), path.alias("path"), qual.alias("qual"))
    have = have.where(F.size(parts) > 1).select("id", "category", "qual", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("path"))
    have = have.groupBy("category", "path", "qual").agg(F.min("id").alias("id"), F.max("id").alias("_other")).where("id = _other").drop("_other")
    category, path, qual = cut(F.col("target"))
    return targets.select("target", category.alias("category"), path.alias("path"), qual.alias("qual")).join(have, ["category", "path", "qual"]).select("target", "id")


def structural_edges(units: DataFrame) -> DataFrame:
    """(src, rel, dst, w): edges that extraction alone supports: defines, inherits and calls inside a file, imports of known modules, follows.

    ``units`` has one row per id. A call of a bare name goes to the file's own top-level unit of that name, else through its
    import binding; ``self.`` and ``cls.`` go to the own class; a dotted name through the binding of its head. What is not found has no edge.
    """
    own = units.select("id", "source_path", "qualname", "kind")
    files = own.where("kind = 'module'").select("source_path", F.col("id").alias("module_id"))
    quals = own.where("qualname is not null").select("source_path", "qualname", F.col("id").alias("dst")).groupBy("source_path", "qualname").agg(F.min("dst").alias("dst"))
    names = module_names(files.select(F.col("source_path").alias("path")).distinct())
    modules = files.groupBy(F.col("source_path").alias("path")).agg(F.min("module_id").alias("module_id"))
    # defines: the enclosing unit, or the module of the file
    has_outer = F.col("qualname").contains(".")
    inner = own.where("qualname is not null").withColumn("outer", F.regexp_replace("qualname", r"\.[^.]*$", ""))
    by_class = inner.where(has_outer).join(quals.select("source_path", F.col("qualname").alias("outer"), F.col("dst").alias("src")), ["source_path", "outer"]).select("src", F.col("id").alias("dst"))
    by_file = inner.where(~has_outer).join(files, "source_path").select(F.col("module_id").alias("src"), F.col("id").alias("dst"))
    defines = by_class.unionByName(by_file).where("src <> dst").select("src", F.lit("defines").alias("rel"), "dst", F.lit(1.0).alias("w"))
    # names to resolve
    call = units.select("id", "source_path", "qualname", F.explode("calls").alias("name")).withColumn("rel", F.lit("calls"))
    base = units.select("id", "source_path", "qualname", F.explode("bases").alias("name")).withColumn("rel", F.lit("inherits"))
    used = call.unionByName(base).where("name is not null and name <> ''").distinct()
    head = F.regexp_extract("name", r"^[^.]+", 0)
    own_class = F.regexp_extract(F.coalesce("qualname", F.lit("")), r"^(.*)\.[^.]*$", 1)
    local = F.when(head.isin("self", "cls") & (own_class != ""), F.concat(own_class, F.regexp_replace("name", r"^[^.]+", ""))).otherwise(F.col("name"))
    used = used.withColumn("local", local).withColumn("head", head)
    bindings = units.where("import_bindings is not null").select("source_path", F.explode("import_bindings").alias("head", "bound")).groupBy("source_path", "head").agg(F.min("bound").alias("bound"))
    used = used.join(quals.select("source_path", F.col("qualname").alias("local"), F.col("dst").alias("here")), ["source_path", "local"], "left").join(bindings, ["source_path", "head"], "left")
    used = used.withColumn("written", F.when(F.col("here").isNull() & F.col("bound").isNotNull(), F.concat("bound", F.expr("substring(name, length(head) + 1)"))))
    found = longest_module(used.where("written is not null").select("written"), names)
    found = found.join(quals.select(F.col("source_path").alias("path"), F.col("qualname").alias("rest"), F.col("dst").alias("there")), ["path", "rest"]).select("written", "there")
    used = used.join(found, "written", "left").select(F.col("id").alias("src"), "rel", F.coalesce("here", "there").alias("dst"))
    used = used.where("dst is not null and dst <> src").select("src", "rel", "dst", F.when(F.col("rel") == "calls", 0.7).otherwise(0.8).alias("w"))
    # imports of modules that are here
    imports = units.select("id", F.explode("imports").alias("written")).where("written is not null and written <> ''").distinct()
    imports = imports.join(longest_module(imports, names), "written").join(modules, "path").where("id <> module_id").select(F.col("id").alias("src"), F.lit("imports").alias("rel"), F.col("module_id").alias("dst"), F.lit(0.6).alias("w"))
    follows = units.where("follows is not null").select(F.col("id").alias("src"), F.lit("follows").alias("rel"), F.col("follows").alias("dst"), F.lit(0.3).alias("w"))
    return defines.unionByName(used).unionByName(imports).unionByName(follows).groupBy("src", "rel", "dst").agg(F.max("w").alias("w"))


def _advance(state: tuple, sizes: list, parts: list, most: int, chars: int):
    """(state, batch of each row) of the fold from ``state`` (part, batch, count, size) on."""
    part, batch, count, size = state
    out = []
    for p, n in zip(parts, sizes, strict=True):
        if p != part:
            part, batch, count, size = p, 1, 0, 0
        elif count and (count >= most or size + n > chars):
            batch, count, size = batch + 1, 0, 0
        count, size = count + 1, size + n
        out.append(batch)
    return (part, batch, count, size), out


def _summaries(most: int, chars: int):
    """Of one range of rows: what the fold needs to know of it, whatever it is entered with.

    As long as a batch is open that began before the range, only how many rows from its start on still belong to it is unknown, and a batch has at most ``most`` rows. So for each of these numbers
    the state at the end is given, with the sizes of these first rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        sizes, parts = rows["n"].tolist(), rows["part"].tolist()
        same = next((i for i, p in enumerate(parts) if p != parts[0]), len(parts))
        head = sizes[: min(most, same)]
        # ends[k]: the state after the range if its row k begins a batch; counted back from the end, each row jumps to the start of the next batch.
        m, total, at = len(sizes), [0], 0
        for n in sizes:
            total.append(total[-1] + n)
        nxt, stop = [0] * m, 0
        for i in range(m):
            stop = max(stop, i + 1)
            while stop < m and parts[stop] == parts[i] and stop - i < most and total[stop + 1] - total[i] <= chars:
                stop += 1
            nxt[i] = stop
        end: list = [None] * (m + 1)
        for i in range(m - 1, -1, -1):
            j = nxt[i]
            if j == m:
                end[i] = (parts[i], 0, m - i, total[m] - total[i])
            else:
                p, b, c, z = end[j]
                end[i] = (p, b + (p == parts[i] == parts[j]), c, z)
        # Batches are numbered within a part: the number at the end counts from the last row that begins a part, or from row k where the part goes on.
        out = []
        for k in range(len(head) + 1):
            if k < m:
                p, _, c, z = end[k]
                b, i = 1, k
                while nxt[i] < m:
                    b = b + 1 if parts[nxt[i]] == parts[i] else 1
                    i = nxt[i]
                out.append((k, p, b, c, z, p == parts[0]))
        return pd.DataFrame({"_part": rows["_part"].iloc[0], "first": parts[0], "rows": m, "same": same, "head": [head], "ends": [[list(map(str, e)) for e in out]]})

    return run


def queue_batches(queue: DataFrame, depth: int = 2, most: int = 60, chars: int = 120_000) -> DataFrame:
    """(part, batch, ord, id): work by directory in the order of ids, cut before a batch would exceed ``most`` units or ``chars`` characters.

    A unit that alone exceeds the limit ships alone. The cut is a fold in order over all units, sorted by range: each range is folded by a task of its own, from the state in which the ranges before it
    end. That state is known before any is folded: a batch has at most ``most`` units, so a range has at most that many ways to begin, and the driver follows one of them through each range.
    """
    rows = queue.select(F.coalesce(subtree(F.col("source_path"), depth), F.lit("_root")).alias("part"), "id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    at = sorted_with_local_rows(rows, [F.col("part"), F.col("id")], "queue")
    kinds = "_part bigint, first string, rows int, same int, head array<bigint>, ends array<array<string>>"
    found = sorted(at.groupBy("_part").applyInPandas(_summaries(most, chars), kinds).collect(), key=lambda r: r["_part"])
    state, starts = (None, 0, 0, 0), []
    for r in found:
        starts.append((r["_part"], *state))
        part, batch, count, size = state
        ends = {int(e[0]): (e[1], int(e[2]), int(e[3]), int(e[4]), e[5] == "True") for e in r["ends"]}
        if part != r["first"]:
            p, b, c, z, _ = ends[0]
            state = (p, b, c, z)
            continue
        k = 0
        while k < len(r["head"]) and not (count and (count >= most or size + r["head"][k] > chars)):
            count, size, k = count + 1, size + r["head"][k], k + 1
        if k in ends and k < r["rows"]:
            p, b, c, z, same = ends[k]
            opens = batch + 1 if k < r["same"] else 1
            state = (p, b + (opens - 1 if same and k < r["same"] else 0), c, z)
        else:
            state = (part, batch, count, size)

    spark = queue.sparkSession
    entry = F.broadcast(spark.createDataFrame(starts, "_part bigint, _p string, _b int, _c int, _z bigint"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        p, b, c, z = (rows[x].iloc[0] for x in ("_p", "_b", "_c", "_z"))
        _, batch = _advance((p, int(b), int(c), int(z)), rows["n"].tolist(), rows["part"].tolist(), most, chars)
        return pd.DataFrame({"part": rows["part"], "id": rows["id"], "batch": batch, "_part": rows["_part"], "_row": rows["_row"]})

    cut = materialize(at.join(entry, "_part").groupBy("_part").applyInPandas(fold, "part string, id string, batch int, _part bigint, _row bigint"), "batches")
    before = F.broadcast(partition_offsets(at, F.lit(1)))
    placed = cut.join(before, "_part").withColumn("at", F.col("_before") + F.col("_row"))
    first = placed.groupBy("part").agg(F.min("at").alias("first"))
    return skew_join(placed, first, ["part"]).select("part", "batch", (F.col("at") - F.col("first") + 1).cast("int").alias("ord"), "id")


def verified_claims(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """(id, verdict, method): each file-backed node against the fresh units of its file: verified, stale if the hash differs, contradicted if unit or file is gone."""
    paths = units.select("source_path").distinct().withColumn("file", F.lit(True))
    fresh = units.select("id", F.col("content_sha").alias("now"), F.lit(True).alias("unit"))
    rows = skew_join(nodes.where("source_kind = 'derived_from_file'"), paths, ["source_path"], "left").join(fresh, "id", "left")
    verdict = F.when(F.col("file").isNull() | F.col("unit").isNull(), "contradicted").when(F.col("now").eqNullSafe(F.col("source_hash")), "verified").otherwise("stale")
    method = F.when(F.col("source_path").endswith(".py"), "ast").when(F.col("type").isin("module", "class", "function", "method", "file"), "grep").otherwise("doc")
    return rows.select("id", verdict.alias("verdict"), method.alias("method"))
