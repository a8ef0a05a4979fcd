from pyspark.sql import functions as F

from memloom.operators.snapshots import normal_hash, snapshot_changes


def test_changes(spark):
    rows = [
        (1, "a", "h1", "p", "t1"), (1, "b", None, "p", "t1"), (1, "c", "h", "p", "t1"), (1, "c", "h", "p", "t1"), (1, "d", "h", "p", "t1"),
        (4, "a", "h2", "p", "t2"), (4, "b", None, "p", "t2"), (4, "c", "h", "q", "t2"), (4, "e", None, None, "t2"), (4, "a", "old", "p", "t0"),
        (9, "a", "h2", "p", "t3"), (9, "b", "h", "p", "t3"), (9, "c", "h", "q", "t3"), (9, "e", None, None, "t3"), (None, "z", "h", "p", "t"), (9, None, "h", "p", "t"),
    ]
    df = spark.createDataFrame(rows, "snap int, id string, sha string, path string, at string").withColumn("change", F.lit("clash"))
    got = {(r["snap"], r["id"]): (r["change"], r["changed_fields"]) for r in snapshot_changes(df, "snap", "id", ["sha", "path"], "at", True).collect()}
    assert got == {(4, "a"): ("changed", ["sha"]), (4, "c"): ("changed", ["path"]), (4, "d"): ("removed", []), (4, "e"): ("added", []), (9, "b"): ("changed", ["sha"])}
    first = snapshot_changes(df, "snap", "id", ["sha"], "at").where("snap = 1").collect()
    assert {(r["id"], r["change"]) for r in first} == {(x, "added") for x in "abcd"}
    assert snapshot_changes(df.where("false"), "snap", "id", ["sha"], "at", True).count() == 0
    assert snapshot_changes(df.where("snap = 1"), "snap", "id", ["sha"], "at", True).count() == 0
    # A base without rows is an empty state, not the first snapshot.
    alone = snapshot_changes(df.where("snap = 1"), "snap", "id", ["sha"], "at", base=0).collect()
    assert {(r["snap"], r["id"], r["change"]) for r in alone} == {(1, x, "added") for x in "abcd"}
    assert snapshot_changes(df, "snap", "id", ["sha"], "at", base=1).where("snap = 1").count() == 0


def test_normal_hash(spark):
    df = spark.createDataFrame([(" SHA256:AB ",), ("ab",), (None,), ("sha256: ab",), ("",)], "h string")
    assert [r[0] for r in df.select(normal_hash(F.col("h"))).collect()] == ["ab", "ab", None, "ab", ""]


def test_edited_files_are_those_of_the_newest_step(spark):
    from memloom.operators.snapshots import edited_files

    rows = [
        (1, "a", "a.py", "h1"), (1, "b", "two.py", "h2"), (1, "c", "two.py", "h3"), (1, "d", "d.py", "h4"), (1, "e", "e.py", None), (1, "f", "f.py", "h5"),
        (4, "a", "a.py", "h9"), (4, "b", "two.py", "h2"), (4, "c", "two.py", "h3"), (4, "d", "d.py", "h4"), (4, "e", "e.py", None), (4, "f", "f.py", "h5"), (4, "x", None, "h6"),
        (7, "a", "a.py", " SHA256:H9"), (7, "b", "two.py", "h2"), (7, "c", "two.py", "h3"), (7, "d", "d.py", "h7"), (7, "e", "e.py", "h8"), (7, "g", "g.py", "h6"), (7, "x", None, "h7"), (7, None, "n.py", "h1"),
    ]
    snaps = spark.createDataFrame(rows, "snap_no int, id string, source_path string, content_sha string").selectExpr("*", "timestamp'2024-01-01 00:00:00' taken_at")
    assert {r[0] for r in edited_files(snaps).collect()} == {"d.py", "e.py", "f.py", "g.py"}
    assert edited_files(snaps.where("snap_no = 1")).count() == 0


def test_used_nodes_are_packed_ones(spark):
    from memloom.queries.learning import usage_attribution
    from memloom.queries.retrieval import retrieve_pack

    used = {(r["case_id"], r["id"]) for r in usage_attribution(spark, "/root/testdata/sf0.01").collect()}
    assert used and used < {(r["case_id"], r["id"]) for r in retrieve_pack(spark, "/root/testdata/sf0.01").collect()}
