from memloom.operators.hierarchy import descendants, hierarchy
from memloom.operators.pointers import resolve_pointers

SCHEMA = "id string, part_of array<struct<topic:string,w:double>>, edges array<struct<rel:string,to:string,w:double>>, node string, root string"


def graph(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_rules_of_parents(spark):
    nodes = graph(spark, [
        ("root", None, [("contains", "a", 1.0), ("contains", "gone", 1.0), (None, None, None)]),
        ("a", [("dir/only", 1.0), (None, 2.0)], None),
        ("b", [("a", 0.5), ("root", 0.5), ("absent", 0.9)], []),
        ("b", [("a", 0.5), ("root", 0.5), ("absent", 0.9)], []),  # delivered twice
        ("c", [("b", None)], None),
        ("self", [("self", 1.0)], None),
        ("x", [("y", 1.0)], None), ("y", [("x", 1.0)], None), ("below", [("x", 1.0)], None),
        (None, [("a", 1.0)], None),
    ])
    got = {r["node_id"]: (r["parent_id"], r["root_id"], r["depth"], r["path"]) for r in hierarchy(nodes, with_path=True).collect()}
    assert got == {
        "root": (None, "root", 0, ["root"]), "a": ("root", "root", 1, ["root", "a"]), "b": ("a", "root", 2, ["root", "a", "b"]), "c": ("b", "root", 3, ["root", "a", "b", "c"]),
        "self": ("self", "", -1, None), "x": ("y", "", -1, None), "y": ("x", "", -1, None), "below": ("x", "", -1, None),
    }
    below = {tuple(r) for r in descendants(nodes).collect()}
    assert below == {("root", "a", 1), ("root", "b", 2), ("a", "b", 1), ("root", "c", 3), ("a", "c", 2), ("b", "c", 1)}


def test_long_chain_orphans_and_empty(spark):
    rows = [(i, i - 1 if i else None) for i in range(70)] + [(100, 99), (101, 100), (None, 5), (3, 2)]
    got = {r["node"]: (r["root"], r["depth"], r["state"]) for r in resolve_pointers(spark.createDataFrame(rows, "node int, parent int")).collect()}
    assert all(got[i] == (0, i, "ok") for i in range(70))
    assert got[100] == (99, 1, "orphan") and got[101] == (99, 2, "orphan") and len(got) == 72
    assert resolve_pointers(spark.createDataFrame([], "node int, parent int"), with_path=True).count() == 0
    assert hierarchy(graph(spark, [])).count() == 0 and descendants(graph(spark, [])).count() == 0
