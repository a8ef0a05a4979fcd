import random

from memloom.llm.leakage import SPANS, allowed, edit_distance, hash_plan, leaked_items, words


def brute(docs, items, window=12):
    out = set()
    for d, text in docs:
        dw = words(text)
        for i, q in items:
            iw = words(q)
            n = min(window, len(iw))
            if d is not None and i is not None and n and any(iw[s : s + n] == dw[p : p + n] for s in range(len(iw) - n + 1) for p in range(len(dw) - n + 1)):
                out.add((d, i))
    return out


def test_exact_windows(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "слово", "ΣΑΣ"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "_"]) for _ in range(n))
    items = [(i, say(r.choice([1, 4, 11, 12, 13, 40]))) for i in range(30)] + [(90, ""), (91, None), (92, "?!"), (None, "w1 w2"), (93, "w0 w1"), (94, "w0 w1")]
    docs = []
    for d in range(80):
        text = say(r.randrange(60))
        if d % 2:
            iw = words(r.choice(items[:30])[1])
            at = r.randrange(max(1, len(iw) - 11))
            part = iw[at : at + r.choice([11, 12, 14])]
            text += " " + r.choice([" ", "...\n", "_"]).join(x.upper() for x in part) + " " + say(5)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, " \n"), (103, "w0 w1 " * 5000), (104, "w0"), (105, "w1")]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string").repartition(3)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    for block in (20_000, 7):
        got = [(x["doc_id"], x["item_id"]) for x in leaked_items(df, tests, block=block).collect()]
        assert set(got) == want and len(got) == len(want) and len(want) > 30
    assert leaked_items(df.where("false"), tests).count() == 0 and leaked_items(df, tests.where("false")).count() == 0


def runs(item, doc, edits):
    """The fewest edits between the item and any run of consecutive words of the document; None for more than it may have."""
    n = len(item)
    k = allowed(n, edits)
    least = min((edit_distance(item, doc[p : p + size]) for p in range(len(doc)) for size in range(max(0, n - k), n + k + 1)), default=n + 1)
    return least if n and least <= k else None


def edited(r, ws, vocabulary, k):
    ws = list(ws)
    for _ in range(k):
        at = r.randrange(len(ws))
        ws[at : at + 1] = r.choice([[], [r.choice(vocabulary)], [r.choice(vocabulary), ws[at]]])
    return ws


def test_recall_of_edited_passages(spark):
    r = random.Random(11)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 12, 17, 30, 60])))) for i in range(90)] + [(95, ""), (96, None), (None, "t1 t2")]
    docs = []
    for i, text in items[:90]:
        ws = words(text)
        docs.append((i, " ".join([r.choice(vocabulary) for _ in range(20)] + edited(r, ws, vocabulary, r.randrange(3)) + [r.choice(vocabulary) for _ in range(i % 4)])))
    docs += [(200, None), (201, "t1"), (202, "")]
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window=None, edits=2).collect()}
    near = {(i, i) for i in range(90)} | got.keys() | {(r.randrange(90), r.randrange(90)) for _ in range(30)}
    said, asked = dict(docs), dict(items)
    want = {(d, i): e for d, i in near if (e := runs(words(asked[i]), words(said[d]), 2)) is not None}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) and len(want) > 60
    assert all(want[x] <= e <= 2 for x, e in got.items()) and sum(e == want[x] for x, e in got.items()) >= 0.9 * len(got)
    assert all(x in got for x, e in want.items() if e == 0)


def test_rounds_stay_few():
    for span in SPANS:
        for k in (1, 2):
            if allowed(span, k) == k:
                assert hash_plan(span, k, 0.99)[1] <= 100, (span, k)
    assert edit_distance([1, 2, 3], [2, 3, 4]) == 2 and allowed(5, 2) == 0 and allowed(12, 2) == 2


def test_recall_in_the_corpus(spark):
    """Every item of the evaluation set with twelve words or more, planted with two edits into a document of the corpus."""
    r = random.Random(3)
    folder = "/root/testdata/sf0.01"
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{folder}/eval_items.parquet").collect()]
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    vocabulary = sorted({w for _, t in docs[:200] for w in words(t)})
    planted, rows = [], []
    asked = [x for x in items if len(words(x[1])) >= 12]
    for n, (doc, text) in enumerate(docs):
        if n < len(asked):
            text = f"{text}\n{' '.join(edited(r, words(asked[n][1]), vocabulary, 2))}\n{text}"
            planted.append((doc, asked[n][0]))
        rows.append((doc, text))
    got = leaked_items(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), spark.createDataFrame(asked, "item_id bigint, text string"), window=None, edits=2)
    found = {(x["doc_id"], x["item_id"]) for x in got.collect()}
    recall = sum(p in found for p in planted) / len(planted)
    print("recall", recall, "of", len(planted))
    assert len(planted) > 50 and recall >= 0.9
