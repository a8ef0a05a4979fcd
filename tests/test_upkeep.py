import random

from memloom.operators import upkeep
from memloom.operators.units import _advance, queue_batches

NODE = (
    "id string, type string, status string, summary string, body string, source_kind string, source_path string, source_hash string, derived_from_hash string, bucket string, tags array<string>, provenance struct<kind:string,commit:string>, "
    "verification struct<status:string,method:string>, part_of array<struct<topic:string,w:double>>, edges array<struct<rel:string,to:string,w:double,coact:int,origin:string>>"
)


def node(i, **k):
    fields = dict.fromkeys(c.split(" ")[0] for c in "type status summary body source_kind source_path source_hash derived_from_hash bucket tags provenance verification part_of edges".split())
    return (i, *(fields | k).values())


def test_conflicts_and_gaps(spark):
    ids = spark.createDataFrame([("code:a", None), ("code:b", "stale"), ("code:c", "active"), ("doc:d", None), (None, None)], "id string, status string").where("id is not null")
    e = spark.createDataFrame([
        ("doc:d", 0, "documents", "code:c"), ("doc:d", 1, "documents", "code:gone"), ("code:a", 0, "documents", "code:gone"), ("code:a", 1, "contradicts", "doc:d"), ("doc:d", 2, "supersedes", "code:a"), ("code:a", 2, "contradicts", "code:a"),
        ("code:a", 3, "supersedes", "nowhere"), ("code:a", 4, None, "code:b"),
    ], "src string, pos int, rel string, dst string")
    assert [tuple(r) for r in upkeep.contradiction_pairs(e, ids).collect()] == [("code:a", "doc:d", "contradicts")]
    got = sorted(map(tuple, upkeep.gaps(ids, e).collect()))
    assert got == [("conflict", "code:a", "code:a"), ("conflict", "code:a", "doc:d"), ("conflict", "doc:d", "code:a"), ("drifted", "doc:d", "code:gone"), ("undocumented", "code:a", None)]
    assert upkeep.gaps(ids.where("false"), e.where("false")).isEmpty() and upkeep.contradiction_pairs(e.where("false"), ids).isEmpty()


def test_audit_and_migration(spark):
    rows = [
        node("code:f", type="function_definition", source_kind="derived_from_file", bucket="code", source_hash="h", derived_from_hash="g", edges=[("calls", "x", 1.0, 0, None), ("documents", "", 1.0, 0, None)]),
        node("hub:overview", type="derived", source_kind="derived", bucket="_hubs", edges=[("documents", "y", 1.0, 0, None), ("documents", "y", 1.0, 0, "authored")]),
        node("note:n", type="adr", source_kind="authored", bucket="code", summary=">>>>>>> theirs"), node("note:n", type="adr", source_kind="authored", bucket="code"), node(None),
    ]
    nodes = spark.createDataFrame(rows, NODE)
    found = {(r["anomaly"], r["id"]) for r in upkeep.audit(nodes.where("coalesce(id, '') <> 'note:n' or summary is not null").unionByName(nodes.where("id = 'hub:overview'")), spark.createDataFrame([("code:f",), ("gone",)], "id string")).collect()}
    assert found == {
        ("unparsable", None), ("duplicate_ids", "hub:overview"), ("path_mismatch", "note:n"), ("path_mismatch", "hub:overview"), ("bad_shape", "code:f"), ("status_inconsistent", "code:f"), ("missing_trust_fields", "code:f"), ("queue_lag", "code:f"), ("queue_lag", "gone"), ("conflict_markers", "note:n"),
    }
    once = upkeep.migrated(nodes)
    got = {r["id"]: r for r in once.collect() if r["id"]}
    assert (got["code:f"]["type"], got["code:f"]["provenance"]["kind"], [e["origin"] for e in got["code:f"]["edges"]]) == ("function", "code", ["structural", "semantic"])
    assert (got["hub:overview"]["type"], got["hub:overview"]["source_kind"], [e["origin"] for e in got["hub:overview"]["edges"]]) == ("overview", "synthesized", ["synthesized", "authored"])
    assert got["note:n"]["provenance"]["kind"] == "user" and got["note:n"]["verification"]["status"] == "unverified"
    assert sorted(map(repr, upkeep.migrated(once).collect())) == sorted(map(repr, once.collect()))


def test_notes_batches_and_repairs(spark):
    notes = spark.createDataFrame([node("n1", type="decision", summary="Keep  it!", tags=["b", None]), node("n2", type="decision", summary="Keep  it!", tags=["b"]), node("n3", type="note", summary="?!", tags=["T a"]), node("n4", type="note", summary=" ")], NODE)
    got = {r["id"]: r for r in upkeep.captured(notes).collect()}
    assert set(got) == {"n1", "n3"} and got["n1"]["notes"] == 2 and got["n1"]["note_id"].startswith("note:keep-it-") and got["n1"]["verified"] == "verified" and got["n3"]["note_id"].startswith("note:t-a-")
    batches = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "id string, batch int")
    assert sorted(map(tuple, upkeep.retired_batches(batches, spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "id string")).collect())) == [(0, 2, 1, False), (1, 1, 1, True)]
    ids = spark.createDataFrame([("code:p/x.py",), ("code:p/x.py::f",), ("code:q/y.py::g",), ("code:q/z.py::g",), ("code:q/h",), ("code:q/y.py::h",)], "id string")
    targets = spark.createDataFrame([("code:f",), ("code:g",), ("code:h",), ("code:p/f",), ("f",), ("doc:f",)], "target string")
    assert [tuple(r) for r in upkeep.bare_targets(targets, ids).collect()] == [("code:f", "code:p/x.py::f")]


def test_moves_commits_and_logs(spark):
    nodes = spark.createDataFrame([
        node("code:a/x.py", source_path="a/x.py", derived_from_hash="h", part_of=[("a", 1.0), ("b", 0.5), (None, 1.0)], edges=[("defines", "code:a/x.py::f", 1.0, 2, None), ("calls", "code:a/x.pyx", 1.0, 0, None)]),
        node("code:a/x.py::f", source_path="a/x.py", derived_from_hash="old", status="active"),
    ], NODE)
    moves = spark.createDataFrame([("code:a/x.py", "code:b/x.py"), ("code:a/x.py::f", "code:b/x.py::f")], "old_id string, new_id string")
    units = spark.createDataFrame([("code:b/x.py", "b/x.py", "code", "h"), ("code:b/x.py::f", "b/x.py", "code", "h")], "id string, source_path string, category string, content_sha string")
    got = {r["id"]: tuple(r)[2:] for r in upkeep.moved_nodes(nodes, moves, units).collect()}
    assert got == {"code:b/x.py": ("b/x.py", "active", False, ["b"], ["code:b/x.py::f", "code:a/x.pyx"]), "code:b/x.py::f": ("b/x.py", "stale", True, ["b"], [])}
    filed = spark.createDataFrame([node(f"n{i}", source_kind="derived_from_file", source_path=p, provenance=("code", c)) for i, (p, c) in enumerate([("x", "c1"), ("y", "c1"), ("x", "c2"), ("x", "c3"), ("x", None), (None, "c1")])], NODE)
    changes = spark.createDataFrame([("c1", "x"), ("c1", "x"), ("c1", None), ("c2", None)], "commit string, path string")
    assert dict(map(tuple, upkeep.commit_staleness(filed, changes).collect())) == {"n0": "stale", "n1": "current", "n2": "current", "n3": "unresolved", "n4": "no_commit"}
    log = spark.createDataFrame([(1, "consolidate | weights folded"), (2, "consolidate | consolidation applied"), (3, "consolidate | weights folded"), (4, "retrieve | weights folded")], "ts int, message string")
    assert tuple(upkeep.fold_state(log).first()) == (3, 2, 1) and tuple(upkeep.fold_state(log.where("false")).first()) == (None, None, 0)
    pack = spark.createDataFrame([("q", "strategic", "a"), ("q", "tactical", "b"), ("q", "periphery", "c"), ("z", "tactical", "a")], "case_id string, tier string, id string")
    steps = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")], "u string, v string")
    assert [tuple(r) for r in upkeep.coactivated(pack, steps).collect()] == [("q", "a", "b")]


def test_queue_of_one_directory(spark):
    """A directory that holds nearly everything is cut over many ranges as one fold would cut it."""
    r = random.Random(4)
    rows = sorted((r.choice(["one/a", "one/b"] + ["big/x"] * 20), f"u{i:04}", "x" * r.choice([0, 1, 5, 30])) for i in range(700))
    got = queue_batches(spark.createDataFrame([(p + "/f", i, t) for p, i, t in rows], "source_path string, id string, text string").repartition(5), 2, 7, 60)
    _, want = _advance((None, 0, 0, 0), [len(t) for _, _, t in rows], [p for p, _, _ in rows], 7, 60)
    assert {x["id"]: x["batch"] for x in got.collect()} == {i: b for (_, i, _), b in zip(rows, want, strict=True)}
    assert queue_batches(spark.createDataFrame([], "source_path string, id string, text string")).isEmpty()


def test_actions_and_guards(spark):
    from memloom.operators.actions import ACTIONS, applied, judged

    nodes = spark.createDataFrame([(x, "note", "active", x.upper()) for x in "abcdefgh"], "id string, type string, status string, summary string")
    barred = spark.createDataFrame([("b",), ("g",)], "id string")
    rows = [
        (1, "merge", "a", ["b"], None, False), (2, "merge", "a", ["b", "gone"], None, True), (3, "merge", "c", ["a"], "x", None), (4, "shorten", "g", None, "s", None), (5, "shorten", "c", [], "s1", None), (6, "shorten", "c", [], "s2", None),
        (7, "promote", "d", None, "decision", None), (8, "reject", "d", None, None, None), (9, "dispute", None, ["e", "nope"], None, None), (10, "dispute", None, ["e", "f", "nope", "g"], None, None), (11, "supersede", "e", ["f"], None, None), (12, "supersede", "e", ["e"], None, None),
        (13, "summarize_episodes", "new", ["h"], "all of it", None), (14, "introduce_subhub", "hub", ["d"], "top", None), (15, "retire", "missing", None, None, None), (16, "retire", None, None, None, None), (None, "retire", "e", None, None, None), (17, "keep_both_with_context", None, ["c", "d"], None, None),
    ]
    actions = spark.createDataFrame(rows, ACTIONS)
    done = judged(actions, nodes, barred)
    got = {r["seq"]: r["outcome"] for r in done.collect()}
    assert {k: v for k, v in got.items() if v != "applied"} == {1: "skipped_protected", 4: "skipped_protected", 9: "skipped_missing", 12: "skipped_missing", 15: "skipped_missing", 16: "skipped_missing"} and len(got) == 17
    out = applied(done, nodes)
    state = {r["id"]: tuple(r)[1:] for r in out["state"].collect()}
    assert state["b"] == ("note", "active", "B", 2, "c") and state["a"] == ("note", "active", "A", 3, "c") and state["c"] == ("note", "active", "s2", None, None)
    assert state["d"] == ("decision", "rejected", "D", None, None) and state["f"][1] == "superseded" and state["e"][1] == "disputed" and state["h"][3:] == (13, "new")
    assert state["new"] == ("section", "active", "all of it", None, None) and state["hub"][0] == "hub" and len(state) == 10
    assert {tuple(r) for r in out["edges"].collect()} == {("e", "contradicts", "f"), ("e", "contradicts", "g"), ("e", "supersedes", "f"), ("c", "contradicts", "d")}
    assert [tuple(r) for r in out["members"].collect()] == [("d", "top", "hub")] and sorted(r["seq"] for r in out["trail"].collect()) == [8, 10, 11, 17]
    off = {r["seq"]: r["outcome"] for r in judged(actions, nodes, barred, enabled=False).collect()}
    assert off[3] == off[13] == off[14] == "skipped_disabled" and off[2] == "applied" and off[7] == "applied"
    assert applied(judged(actions.where("false"), nodes, barred), nodes)["state"].where("archived is not null").isEmpty()
