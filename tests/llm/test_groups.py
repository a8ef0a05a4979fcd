import random

import numpy as np
from pyspark.sql import functions as F

from memloom.llm.components import BETA, connected_groups, decomposed
from memloom.llm.cooccurrence import counting_links, item_pairs


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_groups_equal_union_find(spark):
    r = random.Random(2)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)] + [(f"r{r.randrange(50)}", f"r{r.randrange(50)}") for _ in range(40)]
    pairs += [(b, a) for a, b in pairs[:9]] + pairs[:5] + [("x", "x"), (None, "y"), ("z", None), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("v", F.lit(1)).withColumn("record_id", F.lit("clash"))
    # In one task; by joins until few edges are left; by joins to the end.
    for local in (2_000_000, 60, 0):
        got = connected_groups(df, local_edges=local).collect()
        assert {r["record_id"]: r["group_id"] for r in got} == union_find(pairs) and len(got) == len(union_find(pairs)), local


def test_share_of_edges_cut():
    """A level keeps about 1 - exp(-BETA) of the edges, as the decomposition promises, and the clusters of the last are the components."""
    side = 120
    at = np.arange(side * side).reshape(side, side)
    x, y = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    firsts = []
    for seed in range(5):
        whole, cut = decomposed(x, y, seed=seed)
        firsts.append(cut[0])
        assert len(set(whole.tolist())) == 1 and cut[-1] == 0 and len(cut) <= 12
    assert np.mean(firsts) <= 1 - np.exp(-BETA) + 0.02
    assert decomposed(np.empty(0, int), np.empty(0, int))[1] == []


def test_groups_of_nothing(spark):
    assert connected_groups(spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")).count() == 0
    numbers = connected_groups(spark.createDataFrame([(10, 9), (9, 2)], "a bigint, b bigint")).collect()
    assert {tuple(r) for r in numbers} == {(10, 2), (9, 2), (2, 2)}


def brute_pairs(baskets, min_common, min_lift):
    n = len(baskets)
    count, common = {}, {}
    for items in baskets.values():
        for a in items:
            count[a] = count.get(a, 0) + 1
            for b in items:
                if a < b:
                    common[a, b] = common.get((a, b), 0) + 1
    return {(a, b): (c, count[a], count[b], n) for (a, b), c in common.items() if c >= min_common and c * n >= min_lift * count[a] * count[b]}


def test_item_pairs(spark):
    r = random.Random(4)
    baskets = {f"b{i}": {f"i{min(r.randrange(30), r.randrange(30)):02}" for _ in range(r.randrange(1, 9))} for i in range(120)}
    baskets |= {f"copy{i}": set(baskets["b0"]) | {"only"} for i in range(20)} | {"large": {f"i{i:02}" for i in range(30)}, "large2": {f"i{i:02}" for i in range(30)}}
    rows = [(b, i) for b, items in baskets.items() for i in items]
    df = spark.createDataFrame(rows + rows[:30] + [(None, "i01"), ("b1", None)], "basket string, item string").withColumn("k", F.lit(0)).withColumn("n", F.lit(0))
    for common, lift, block in ((1, None, 256), (5, 1.5, 256), (5, 1.5, 4)):
        got = {(x["item_a"], x["item_b"]): (x["common"], x["count_a"], x["count_b"], x["baskets"]) for x in item_pairs(df, "basket", "item", common, lift, block).collect()}
        assert got == brute_pairs(baskets, common, lift or 0)
    one = item_pairs(spark.createDataFrame([("b", "y"), ("b", "x"), ("c", "x")], "basket string, item string"), "basket", "item").first()
    assert (one["item_a"], one["item_b"], one["lift"]) == ("x", "y", 1.0) and one["conviction"] == 1.0
    assert item_pairs(df.where("false"), "basket", "item").count() == 0


def test_counting_links(spark):
    rows = [("s", "t", 1), ("s", "s", 1), ("s", None, 1), ("s", "u", 0), ("s", "v", None), (None, "v", 2)]
    assert counting_links(spark.createDataFrame(rows, "source string, target string, coact int")).collect() == [("s", "t")]
