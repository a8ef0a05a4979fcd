import random
import re

from pyspark.sql import functions as F

from memloom.llm import neardup
from memloom.llm.neardup import near_duplicates, record_pairs


def made(r):
    vocabulary = [f"w{i}" for i in range(300)]
    docs = {}
    for i in range(120):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 6, 8, 20, 60, 130, 300]))]
        docs[f"n{i:03}"] = " ".join(base)
        if i % 3 == 0:
            edited = list(base)
            for _ in range(max(1, len(base) // 15)):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            r.shuffle(edited)
            docs[f"e{i:03}"] = " ".join(edited)
        if i % 5 == 0:
            docs[f"z{i:03}"] = docs[f"n{i:03}"].upper() + " ..."
    return docs


def brute(docs):
    sets = {k: {w.lower() for w in re.findall(r"\w+", v or "")} for k, v in docs.items() if k}
    ids = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 82 * len(sets[a] | sets[b])}


def test_equals_brute_force(spark, monkeypatch):
    docs = made(random.Random(8)) | {"empty": "", "null": None, "marks": "?! --", "one": "solo", "two": "Solo solo"}
    rows = [*docs.items(), ("n000", docs["n000"]), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "id string, said string").withColumn("k", F.lit(1)).withColumn("class_id", F.lit("clash"))
    want = brute(docs)
    members, pairs = near_duplicates(df, "id", F.col("said"))
    got = [tuple(r) for r in record_pairs(members, pairs).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 40
    assert members.where("record_id in ('empty', 'null', 'marks')").count() == 0
    # the same through crowded tiles, and with parts that are all taken for small
    monkeypatch.setattr(neardup, "SMALL_PART", 9)
    monkeypatch.setattr(neardup, "self_pairs", lambda *a: __import__("memloom.operators.skew", fromlist=["x"]).self_pairs(*a, tile=5))
    members, pairs = near_duplicates(df, "id", F.col("said"))
    assert {tuple(r) for r in record_pairs(members, pairs).collect()} == want


def test_empty(spark):
    members, pairs = near_duplicates(spark.createDataFrame([], "id string, said string"), "id", F.col("said"))
    assert members.count() == 0 and pairs.count() == 0 and record_pairs(members, pairs).count() == 0
