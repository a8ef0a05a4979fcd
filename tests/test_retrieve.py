import os
import random

from memloom.plans import config
from memloom.plans.retrieve import pack, retrieve

NODE = (
    "id string, type string, status string, summary string, body string, source_path string, lineno int, line_end int, confidence double, verification struct<status:string>, tags array<string>, "
    "part_of array<struct<topic:string,w:double>>, edges array<struct<rel:string,to:string,w:double,coact:int,last_used:string,origin:string>>"
)


def node(i, kind="note", status="active", summary="", body="", edges=(), part_of=()):
    return (i, kind, status, summary, body, None, None, None, None, None, None, list(part_of), [(r, t, w, 0, None, None) for r, t, w in edges])


def test_multi_hop_status_and_budget(spark):
    rows = [
        node("hub:auth", "hub", summary="login subsystem", edges=[("documents", "code:a", 0.9)]),
        node("code:a", "module", summary="token issuing", edges=[("defines", "code:f", 1.0)]),
        node("code:f", "function", summary="rotate", part_of=[("hub:auth", 0.5), ("some/dir", 0.5)]),
        node("note:old", status="superseded", summary="login"), node("note:new", summary="login"),
        node("note:far", summary="unrelated words"), node("note:far", summary="unrelated words"),
    ]
    nodes = spark.createDataFrame(rows, NODE)
    asked = spark.createDataFrame([("q", "login subsystem"), ("none", "zzz")], "case_id string, query string")
    out = retrieve(nodes, asked)
    active = {r["id"]: r["activation"] for r in out["activations"].collect()}
    assert max(active.values()) == 1 and active["code:f"] > 0 and "note:far" not in active
    assert abs(active["note:old"] / active["note:new"] - 0.2) < 1e-9
    tiers = {r["id"]: r["tier"] for r in out["pack"].collect()}
    assert tiers["hub:auth"] == "strategic" and tiers["code:a"] == "tactical" and tiers["code:f"] == "operational"
    lifted = {r["id"]: r["activation"] for r in retrieve(nodes, asked, intent="history")["activations"].collect()}
    assert abs(lifted["note:old"] / lifted["note:new"] - 1) < 1e-9
    assert retrieve(nodes.where("false"), asked)["pack"].count() == 0


def test_first_fit_lets_later_small_nodes_in(spark):
    nodes = spark.createDataFrame([node("n1", "section", body="x" * 16), node("n2", "section", body="y" * 400), node("n3", "section", body="z" * 8)], NODE)
    active = spark.createDataFrame([("q", "n1", 1.0), ("q", "n2", 0.9), ("q", "n3", 0.8), ("q", "n1x", 0.01)], "case_id string, id string, activation double")
    got = {r["id"]: (r["tier"], r["ord"]) for r in pack(active, nodes, config.profile(budget={"operational": 14})).collect()}
    assert got == {"n1": ("operational", 1), "n3": ("operational", 2), "n2": ("periphery", 1)}


def test_fold_over_the_first_of_each_cost(spark):
    """Where only the first rows of each cost enter the fold the pack is the same."""
    r = random.Random(5)
    nodes = spark.createDataFrame([node(f"n{i}", r.choice(["section", "module", "hub"]), body="x" * r.randrange(60), summary="y" * r.randrange(20)) for i in range(150)], NODE)
    active = spark.createDataFrame([(q, f"n{i}", round(0.02 + r.randrange(20) / 25, 3)) for q in "qz" for i in range(150)], "case_id string, id string, activation double")
    settings = config.profile(budget={"operational": 90, "tactical": 40, "strategic": 25, "periphery": 7})
    whole = sorted(map(tuple, pack(active, nodes, settings).collect()))
    assert whole == sorted(map(tuple, pack(active, nodes, settings, folded=0).collect())) and len(whole) > 20


def test_held_is_what_the_packs_hold(spark):
    """What a task finds is what the packs have: with pairs, leaves, chains, nodes without an arc, equal texts, budgets that fill up and wanted rows of every rank."""
    from memloom.plans.held import held

    r = random.Random(11)
    words = ["the", "the", "of", "of", *[f"w{i}" for i in range(25)]]
    rows = []
    for i in range(160):
        to = [f"n{r.randrange(i, 160) if r.random() < 0.7 else r.randrange(6)}" for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
        edges = [(r.choice(["calls", "exemplifies", "follows", None]), t, r.choice([None, 0.3, 1.0])) for t in [*to, "n0" if i % 9 == 0 else "nowhere"]]
        text = " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))
        rows.append(node(f"n{i}", r.choice(["section", "module", "hub", "adr"]), r.choice(["active", "superseded", "disputed", None]), text, r.choice(["", text * 3]), edges))
    nodes = spark.createDataFrame(rows + rows[:3], NODE)
    asked = spark.createDataFrame([(f"n{i}", rows[i][3]) for i in range(0, 160, 8)] + [("none", "zzz"), ("twice", "w1 w1 the")], "case_id string, query string")
    wanted = asked.select("case_id").crossJoin(nodes.select("id").distinct()).unionByName(spark.createDataFrame([("n0", "elsewhere"), ("unasked", "n1")], "case_id string, id string"))
    settings = config.profile(tolerance=0.0, budget={"operational": 60, "tactical": 40, "strategic": 50, "periphery": 5})
    packs = sorted(map(tuple, retrieve(nodes, asked, settings)["pack"].select("case_id", "id").collect()))
    assert packs == sorted(map(tuple, held(nodes, asked, wanted, settings).collect())) and 200 < len(packs) < 2000
    some = wanted.sample(0.04, seed=3).cache()
    assert sorted(map(tuple, held(nodes, asked, some, settings).collect())) == sorted(set(packs) & set(map(tuple, some.collect())))
    early = config.profile(tolerance=0.01)
    assert held(nodes, asked, some, early).count() == retrieve(nodes, asked, early)["pack"].join(some, ["case_id", "id"], "left_semi").count()


def test_transfer_recall_writes_no_row_for_each_case_and_node(spark, tmp_path):
    """Seventy instances that share a word with 600 nodes: no table that is written has a row for each pair of them."""
    import memloom.session as session
    from memloom.queries.learning import transfer_recall

    rows = [node(f"{'x' * (i % 3 + 1)}:{i}", summary=f"the w{i % 7}", edges=[("exemplifies", "xxxx:p", 1.0)] if i % 3 == 0 and i < 300 else []) for i in range(600)]
    spark.createDataFrame([*rows, node("xxxx:p", "adr", summary="the pattern")], NODE).write.parquet(f"{tmp_path}/nodes.parquet")
    folder = session._own_folder(spark)
    before = set(os.listdir(folder.removeprefix("file:"))) if os.path.exists(folder.removeprefix("file:")) else set()
    got = transfer_recall(spark, str(tmp_path)).collect()
    assert len(got) == 70 and all(r["gold"] == 70 for r in got) and sum(r["recall"] for r in got) > 0
    written = [f"{folder}/{x}" for x in set(os.listdir(folder.removeprefix("file:"))) - before]
    assert written and max(spark.read.parquet(x).count() for x in written) < 70 * 600 / 4
