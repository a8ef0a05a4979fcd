import json
import random

import pytest
from pyspark.sql import functions as F

from memloom.functions.text import slug, token_estimate, tokens
from memloom.operators import learning, merging
from memloom.operators.bm25 import bm25, normalised
from memloom.operators.graph import degrees, isolated, min_labels, reachable
from memloom.operators.ordering import global_positions
from memloom.operators.pagerank import personalized_pagerank, transition
from memloom.operators.similar import cosine_top, lexical_top, token_near_duplicates
from memloom.operators.skew import hot_keys, self_pairs, skew_join
from memloom.operators.units import longest_module, module_names, paired_moves, queue_batches, repaired_targets
from memloom.plans import config


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("k%d" % i, i) for i in range(20)] + [(None, 1)], "k string, x int")
    right = spark.createDataFrame([("hot", "H"), ("k1", "A"), ("zz", "B")], "k string, y string")
    assert hot_keys(left, ["k"], 10).count() == 1
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(repr, left.join(right, ["k"], how).collect()))
        assert sorted(map(repr, skew_join(left, right, ["k"], how, rows=10).collect())) == want
        # Beyond the bound on hot keys their rows are salted instead.
        assert sorted(map(repr, skew_join(left, right, ["k"], how, rows=10, keys=0).collect())) == want


def test_self_pairs_in_tiles(spark):
    rows = spark.createDataFrame([("a", i, i % 7 + 1) for i in range(40)] + [("b", 1, 1), ("b", 2, 1), (None, 3, 1)], "k string, id int, size int")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40)} | {(1, 2)}
    for tile in (1000, 8):
        got = [(r["a"]["id"], r["b"]["id"], ) for r in self_pairs(rows, "k", "id", tile=tile).collect()]
        assert len(got) == len(want) + 1 and set(got) == want  # (1, 2) is a pair of both keys
    close = lambda a, b: F.abs(a["size"] - b["size"]) <= 1
    plain = {tuple(sorted((r["a"]["id"], r["b"]["id"]))) for r in self_pairs(rows, "k", "id", close).collect()}
    banded = {tuple(sorted((r["a"]["id"], r["b"]["id"]))) for r in self_pairs(rows, "k", "id", close, lambda r: r["size"], tile=8).collect()}
    assert plain == banded


def test_global_positions(spark):
    values = [random.Random(1).randrange(5) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(7)
    got = {r["i"]: r["_pos"] for r in global_positions(df, [F.col("v"), F.col("i")]).collect()}
    order = sorted(range(300), key=lambda i: (values[i], i))
    assert got == {i: p for p, i in enumerate(order, 1)}
    assert global_positions(df.where("false"), [F.col("v")]).count() == 0


def test_bm25(spark):
    import math

    docs = {"a": ["x", "x", "y"], "b": ["y", "z"], "c": [], "d": ["x"]}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()] + [("e", None)], "id string, tokens array<string>")
    got = {r["id"]: r["score"] for r in bm25(df, spark.createDataFrame([("q", ["x", "x", "nope"])], "case_id string, tokens array<string>")).collect()}
    n, avg = 5, 6 / 5
    idf = math.log(1 + (n - 2 + 0.5) / (2 + 0.5))
    want = {k: 2 * idf * v.count("x") * 2.5 / (v.count("x") + 1.5 * (0.25 + 0.75 * len(v) / avg)) for k, v in docs.items() if "x" in v}
    assert got == pytest.approx(want)
    shares = normalised(spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("q", "c", -1.0)], "case_id string, id string, score double")).collect()
    assert {r["id"]: r["score"] for r in shares} == {"a": 0.75, "b": 0.25}


def test_pagerank_engines_agree(spark):
    r = random.Random(3)
    arcs = {(f"n{r.randrange(30)}", f"n{r.randrange(30)}"): r.random() for _ in range(60)}
    steps = transition(spark.createDataFrame([(u, v, c) for (u, v), c in arcs.items() if u != v], "u string, v string, c double"))
    start = spark.createDataFrame([("p", "n1", 2.0), ("p", "n2", 1.0), ("q", "alone", 1.0), ("q", "n5", 0.0), (None, None, None)], "case_id string, id string, mass double")
    by = {}
    for engine in ("kernel", "join"):
        by[engine] = {(x["case_id"], x["id"]): x["mass"] for x in personalized_pagerank(start, steps, rounds=12, tolerance=0, engine=engine).collect()}
        assert sum(m for (c, _), m in by[engine].items() if c == "p") == pytest.approx(1)
    assert by["kernel"] == pytest.approx(by["join"], abs=1e-12)
    assert by["kernel"]["q", "alone"] == pytest.approx(1)
    early = {}
    for engine in ("kernel", "join"):
        early[engine] = {(x["case_id"], x["id"]): x["mass"] for x in personalized_pagerank(start, steps, rounds=200, tolerance=1e-2, engine=engine).collect()}
    # Each case stops by itself: q at once, p some rounds later.
    assert early["kernel"] == pytest.approx(early["join"], abs=1e-12) and early["kernel"] != pytest.approx(by["kernel"], abs=1e-6)
    assert sum(m for (c, _), m in early["join"].items() if c == "p") == pytest.approx(1)


def test_graph_operators(spark):
    ids = spark.createDataFrame([(x,) for x in "abcdefgh"], "id string")
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("f", "f"), ("g", "zz"), ("a", None)], "x string, y string")
    assert min_labels(pairs.where("false"), ids).where("id <> component").isEmpty()
    for arcs in (2_000_000, 0):
        assert {r["id"]: r["component"] for r in min_labels(pairs, ids, arcs).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g", "h": "h"}
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    stop = spark.createDataFrame([("d",)], "id string")
    for arcs in (2_000_000, 0):
        assert {tuple(r) for r in reachable(ids, steps, kernel_arcs=arcs).collect()} == {(s, x) for s in "abc" for x in "abcde" if s != x} | {("d", "e")}
        assert {tuple(r) for r in reachable(spark.createDataFrame([("a",)], "id string"), steps, stop, arcs).collect()} == {("a", "b"), ("a", "c")}
    assert reachable(ids, steps.where("false")).isEmpty() and reachable(ids.where("false"), steps).isEmpty()
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c"), ("a", "gone")], "src string, dst string")
    assert {r["id"]: r["degree"] for r in degrees(e, ids).collect() if r["degree"]} == {"a": 2, "b": 2, "c": 2}
    m = spark.createDataFrame([("d", "e", 1.0), ("h", "dir", 1.0)], "src string, topic string, w double")
    assert {r[0] for r in isolated(e, m, ids).collect()} == set("cfgh")


def test_merges(spark):
    e = spark.createDataFrame([("a", "r", "b", 0.2, 1, 1), ("a", "r", "b", 0.7, 2, 0), ("a", "r", "a", 1.0, 1, 1), ("a", "s", "b", None, None, 1)], "src string, rel string, dst string, w double, coact int, pos int")
    assert {tuple(r) for r in merging.strongest_edges(e).collect()} == {("a", "r", "b", 0.7, 3), ("a", "s", "b", 0.0, 0)}
    assert ("a", "r", "b", 0.7, 2) in {tuple(r) for r in merging.refreshed_edges(e, "pos").collect()}
    m = spark.createDataFrame([("n", "t", 0.2, 0), ("n", "t", 0.8, 1), ("n", "u", 0.8, 2)], "src string, topic string, w double, pos int")
    assert {tuple(r) for r in merging.strongest_memberships(m).collect()} == {("n", "t", 0.5), ("n", "u", 0.5)}
    moved = merging.redirected(e, spark.createDataFrame([("b", "c")], "old string, new string"))
    assert {r["dst"] for r in moved.collect()} == {"c"}


def test_fold_weights(spark):
    e = spark.createDataFrame([("s", "a", 0.5, 1), ("s", "b", 0.06, 0), ("s", "c", 0.5, None), ("s", "d", 0.5, 0)], "src string, dst string, w double, coact int")
    seen = spark.createDataFrame([("a", "s", 2), ("b", "s", 1)], "a string, b string, n bigint")
    good, bad = spark.createDataFrame([("a", "s")], "a string, b string"), spark.createDataFrame([("d", "s")], "a string, b string")
    got = {r["dst"]: (r["w"], r["coact"]) for r in learning.fold_weights(e, seen, good, bad, 0.1, 0.02, 0.05, 0.5).collect()}
    assert got == {"a": (0.55, 3), "c": (0.5, 0), "d": (0.45, 0)}
    still = {r["dst"]: r["w"] for r in learning.fold_weights(e, seen, good.where("false"), bad.where("false"), 0.1, 0.02, 0.05, 0.5).collect()}
    assert still == {"a": 0.5, "b": 0.06, "c": 0.5, "d": 0.5}


def test_survivors_and_items(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("a", None), ("k", "prot")], "keep_id string, drop_id string")
    safe = spark.createDataFrame([("prot",)], "id string")
    assert {tuple(r) for r in learning.survivors(merges, safe).collect()} == {("b", "a"), ("c", "a"), ("y", "x")}
    nodes = spark.createDataFrame([("n", "h", "old", 0.4)], "id string, source_hash string, summary string, confidence double")
    items = spark.createDataFrame(
        [(1, "n", None, "one", "h", None), (2, "n", None, None, "h", 1.4), (3, "n", None, "stale", "zz", None), (4, "new", "note", "made", None, None), (5, "gone", None, "x", None, None), (6, None, "note", "x", None, None)],
        "seq int, id string, type string, summary string, content_sha string, confidence double",
    )
    got = {(r["id"], r["outcome"]): (r["items"], r["summary"], r["confidence"]) for r in learning.applied_items(items, nodes).collect()}
    assert got["n", "updated"] == (2, "one", 1.0) and got["n", "skipped_stale"][0] == 1 and got["new", "created"] == (1, "made", 0.7) and got["gone", "skipped_missing"][0] == 1


def test_similarity_against_brute_force(spark):
    r = random.Random(5)
    sets = {i: {f"word{r.randrange(25)}" for _ in range(r.randrange(0, 12))} for i in range(60)}
    sets[60] = set(sets[0])
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [(None, ["word1"])], "id int, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(x["a"], x["b"]) for x in token_near_duplicates(df, 0.5).collect()} == want
    vecs = {i: [r.uniform(-1, 1) for _ in range(6)] for i in range(50)}
    v = spark.createDataFrame([*vecs.items(), (99, None), (98, [0.0] * 6), (None, [1.0] * 6)], "id int, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(i, j) for i in vecs for _, j in sorted(((cos(vecs[i], vecs[j]), j) for j in vecs if j != i and cos(vecs[i], vecs[j]) >= 0.3), reverse=True)[:4]}
    for block in (4096, 16):
        assert {(x["id"], x["other"]) for x in cosine_top(v, 4, 0.3, block).collect()} == want


def shuffled(spark):
    """MB that the session's tasks have written for shuffles so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite() / 1e6


def test_near_duplicates_write_no_pairs_that_are_only_possible(spark):
    # All sets share words with many others, few are similar: what is written grows with the sets, not with their pairs.
    r = random.Random(3)
    sets = {i: set(r.sample(range(400), 40)) for i in range(2_000)}
    for i in range(0, 100, 10):
        sets[2_000 + i] = sets[i] - {next(iter(sets[i]))} | {400 + i}
        sets[3_000 + i] = set(sets[i])
    sets[4_000], sets[4_001], sets[4_002] = {1}, {1}, {1, 2}
    df = spark.createDataFrame([(k, [f"word{x}" for x in v]) for k, v in sets.items()], "id int, tokens array<string>")
    before = shuffled(spark)
    got = {(x["a"], x["b"]): x["sim"] for x in token_near_duplicates(df, 0.82).collect()}
    assert shuffled(spark) - before < 12
    few = [k for k in sets if k < 100 or k >= 2_000]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in few for b in few if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.82}
    assert got == want and len(got) == 31
    # The same through crowded tiles.
    assert {(x["a"], x["b"]) for x in token_near_duplicates(df.where("id < 100 or id >= 2000"), 0.82, tile=2).collect()} == set(want)


def test_lexical_candidates_of_all_eligible_rows(spark):
    r = random.Random(11)
    docs = [(f"n{i:02}", [r.choice("apple birch cedar daisy elder fern grape hazel iris jade kelp lime".split()) for _ in range(r.randrange(1, 6))] + ["common", "to"], r.choice(["code", "doc", None]), r.choice(["a.md", "b.md", "", None])) for i in range(60)]
    known = [(f"n{a:02}", f"n{b:02}") for a, b in (r.sample(range(60), 2) for _ in range(200))] + [("n01", "gone"), (None, "n02")]
    words = {d[0]: {t for t in d[1] if len(t) >= 3} for d in docs}
    often = {t for ws in words.values() for t in ws if sum(t in o for o in words.values()) > 15}
    assert "common" in often
    barred, want = {frozenset(k) for k in known}, set()
    for a, _, ga, fa in docs:
        near = []
        for b, _, gb, fb in docs:
            shared = len((words[a] & words[b]) - often)
            if a != b and shared >= 2 and ((ga or "?") != (gb or "?") or (fa and fb and fa != fb)) and frozenset((a, b)) not in barred:
                near.append((-round(shared / len(words[a] | words[b]), 4), b))
        want |= {(a, b, i, -s) for i, (s, b) in enumerate(sorted(near)[:5], 1)}
    assert any(s < 0.35 for *_, s in want) and len(want) > 100
    rows = spark.createDataFrame(docs, "id string, tokens array<string>, bucket string, path string")
    pairs = spark.createDataFrame(known, "a string, b string")
    for block in (1000, 16):
        assert {tuple(x) for x in lexical_top(rows, pairs, 5, block=block).collect()} == want
    assert lexical_top(rows.where("false"), pairs, 5).count() == 0


def test_lexical_candidates_write_rows_once_a_segment(spark):
    # Sixteen segments: no row is shuffled to each of them.
    r = random.Random(4)
    rows = [(f"n{i:04}", [f"w{x}" for x in r.sample(range(300), 30)], "doc", f"{i}.md") for i in range(1_600)]
    rows += [("twin", rows[0][1], "doc", "x.md"), ("file", rows[0][1], "doc", "0.md")]
    df = spark.createDataFrame(rows, "id string, tokens array<string>, bucket string, path string")
    before = shuffled(spark)
    got = lexical_top(df, spark.createDataFrame([("n0000", "n0001")], "a string, b string"), 5, block=100).collect()
    assert shuffled(spark) - before < 3
    assert len(got) == 5 * len(rows) and {tuple(x) for x in got if x["id"] in ("n0000", "twin") and x["rank"] == 1} == {("n0000", "twin", 1, 1.0), ("twin", "file", 1, 1.0)}


def test_nominees_see_nodes_of_files(spark, tmp_path):
    from memloom.queries.learning import lexical_candidates

    node = "id string, summary string, status string, bucket string, source_path string, source_kind string, body string, tags array<string>, part_of array<struct<topic: string, w: double>>, edges array<struct<rel: string, to: string, w: double, coact: int, last_used: string, origin: string>>"
    rows = [(f"doc:x{i}", s, st, "doc", f"{i}.md", "derived_from_file", None, None, None, None) for i, (s, st) in enumerate([("red kite bird", None), ("red kite sky blue green", "active"), ("red kite bird", "stale"), (" ", None)])]
    spark.createDataFrame(rows, node).write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([], "a string, b string, verdict string").write.parquet(f"{tmp_path}/duplicate_pairs.parquet")
    assert {tuple(r)[:3] for r in lexical_candidates(spark, str(tmp_path)).collect()} == {("doc:x0", "doc:x1", 1), ("doc:x1", "doc:x0", 1)}


def test_units(spark):
    names = module_names(spark.createDataFrame([("src/pkg/util.py",), ("lib/other/util.py",), ("src/pkg/__init__.py",)], "path string"))
    assert {r["name"]: r["path"] for r in names.collect()} == {"src.pkg.util": "src/pkg/util.py", "pkg.util": "src/pkg/util.py", "lib.other.util": "lib/other/util.py", "other.util": "lib/other/util.py", "src.pkg": "src/pkg/__init__.py", "pkg": "src/pkg/__init__.py"}
    found = longest_module(spark.createDataFrame([("pkg.util.helper",), ("json.loads",), ("pkg",)], "written string"), names)
    assert {tuple(r) for r in found.collect()} == {("pkg.util.helper", "src/pkg/util.py", "helper"), ("pkg", "src/pkg/__init__.py", "")}
    ids = spark.createDataFrame([("code:a/b/c.py::f",), ("code:x/b/d.py::f",), ("code:y/b/d.py::f",)], "id string")
    wanted = spark.createDataFrame([("code:b/c.py::f",), ("code:b/d.py::f",), ("code:c.py::g",)], "target string")
    assert [tuple(r) for r in repaired_targets(wanted, ids).collect()] == [("code:b/c.py::f", "code:a/b/c.py::f")]
    gone = spark.createDataFrame([("g2", "h"), ("g1", "h"), ("g3", None)], "id string, sha string")
    come = spark.createDataFrame([("n1", "h"), ("n2", "k"), ("n3", None)], "id string, sha string")
    assert [tuple(r) for r in paired_moves(gone, come).collect()] == [("g1", "n1")]
    queue = spark.createDataFrame([("d/f", f"u{i}", "x" * n) for i, n in enumerate([4, 4, 20, 1, None or 1])], "source_path string, id string, text string")
    assert [r["batch"] for r in queue_batches(queue, 1, 3, 10).orderBy("id").collect()] == [1, 1, 2, 3, 3]


def test_text(spark):
    df = spark.createDataFrame([("Größe_1 жук ok",), (None,), ("",), ("漢字かな",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["größe_1", "жук", "ok"], [], [], ["漢字かな"]]
    assert [r[0] for r in df.select(token_estimate(F.col("t"))).collect()] == [4, 1, 1, 2]
    assert spark.createDataFrame([(" A b/C! ",)], "t string").select(slug(F.col("t"))).first()[0] == "a-bc"
    assert config.profile("template", budget={"tactical": 1})["budget"] == {"strategic": 4000, "tactical": 1, "operational": 24000, "periphery": 60}
    assert json.dumps(config.PROFILES["defaults"]["budget"])


def test_merged_nodes_and_gate(spark):
    edge = "rel string, to string, w double, coact int, last_used string, origin string"
    e = lambda rel, to, w, n=None: (rel, to, w, n, None, None)
    rows = [
        ("a", [e("uses", "x", 0.4, 1), e("uses", "b", 0.9)], [("t", 0.8)]), ("b", [e("uses", "x", 0.6, 2), e("calls", "y", None)], [("t", 0.5), ("u", 0.6)]),
        ("x", [e("uses", "b", 0.3), e("uses", "a", 0.2)], [("b", 0.5)]), ("y", [e("uses", "x", 0.1), e("uses", "x", 0.2)], None),
    ]
    nodes = spark.createDataFrame(rows, f"id string, edges array<struct<{edge}>>, part_of array<struct<topic: string, w: double>>")
    got = {r["id"]: (sorted((x["rel"], x["to"], x["w"], x["coact"]) for x in r["edges"] or []), sorted(map(tuple, r["part_of"] or []))) for r in merging.merged_nodes(nodes, spark.createDataFrame([("b", "a")], "old string, new string")).collect()}
    assert got == {
        "a": ([("calls", "y", None, None), ("uses", "x", 0.6, 3)], [("t", 0.5714), ("u", 0.4286)]),
        "x": ([("uses", "a", 0.3, 0)], [("a", 0.5)]), "y": ([("uses", "x", 0.1, None), ("uses", "x", 0.2, None)], []),
    }
    gold = spark.createDataFrame([("q", "a", False), ("q", "b", True), ("q", "x", True), ("q", "y", False), ("p", "a", False)], "case_id string, id string, hop boolean")
    pack = lambda *xs: spark.createDataFrame(list(xs), "case_id string, id string")
    before = pack(("q", "a"), ("q", "b"), ("q", "x"), ("p", "a"))
    out = {r["case_id"]: r.asDict() for r in learning.gate(gold, before, pack(("q", "a"), ("q", "x"), ("p", "a")), -0.02).collect()}
    assert out["q"]["lost"] == ["b"] and out["p"]["lost"] == [] and (out["q"]["recall_before"], out["q"]["recall_after"], out["q"]["hop_recall_after"]) == (0.75, 0.5, 0.5)
    assert {(r["recall_delta"], r["hop_recall_delta"], r["status"]) for r in out.values()} == {(-0.125, -0.5, "rejected")}
    assert {r["status"] for r in learning.gate(gold, before, before, -0.02).collect()} == {"ok"}
