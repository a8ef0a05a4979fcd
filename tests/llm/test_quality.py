import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from memloom.llm.quality import STATISTICS, common_words, document_statistics, outlier_scores, tail_probabilities, text_statistics

PROSE = "We keep the old draft only if the owner of the other one has not been asked. "
MORE = "When the first of them is late, they do not wait for it but go on with what is there. Nobody has to read all of that, because most of it is known. "
KINDS = {
    "prose": [PROSE + MORE, "# A heading\n\n" + PROSE, "> " + PROSE, PROSE.lower().rstrip(". "), "\n".join((PROSE + MORE).split(". ")), PROSE + MORE + "\n\n- one\n- two\n\n" + "That is why it was kept as it is.", PROSE * 3, MORE * 2],
    "not_prose": ["- red box\n- blue box\n- green lid\n" * 4, "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | no |\n" * 3, "x;y;z\n1;2;3\n4;5;6\n", "name      size      kind\nbox       12        lid\nlid       no        box\n", "page not found " * 30, "%$ ]{ >< ~~ ^^ |\\ @@\n" * 9, '{"a": 1, "b": [2, 3]}\n' * 5, "one\n" * 40],
}
COMMON = {"en": frozenset("the is not it of and to we if they".split()), "de": frozenset("der die nicht wir wie war".split())}


def test_statistics_of_a_text():
    lang, values = text_statistics("It is not a box_1.\n\n- the lid; 2\r\nand so on", COMMON)
    got = dict(zip(STATISTICS, values, strict=True))
    assert lang == "en" and got["words"] == 10 and got["item_line_share"] == 333 and got["stop_line_share"] == 333 and got["common_word_share"] == 500 and got["distinct_share"] == 1000
    assert text_statistics(None, COMMON) is None and text_statistics(" \n\t", COMMON) is None and text_statistics("box lid", COMMON)[0] is None and text_statistics("?!", {})[0] is None
    assert text_statistics("Wir wissen nicht, wie es war", COMMON)[0] == "de"
    assert len(text_statistics("x" * 2_000_000, COMMON)[1]) == len(STATISTICS)


def test_common_words_come_from_the_corpus(spark):
    rows = [(i, "the cat and the dog" if i % 3 else "the end", "EN-us") for i in range(60)] + [(i, "der Hund und die Katze", " de") for i in range(60, 90)] + [(i, f"odd{i}", None) for i in range(90, 95)] + [(99, None, "en"), (98, "rare", "zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert common_words(df, 3, 0.05) == {"en": {"the", "and", "cat"}, "de": {"der", "die", "hund"}}
    assert common_words(df.where("false")) == {}


def test_exact_tails(spark):
    r = random.Random(3)
    rows = [("a", r.randrange(6)) for _ in range(500)] + [("b", 1)] + [("c", 7)] * 300
    for small in (None, 0):
        got = {(x["g"], x["v"]): (x["at_most"], x["at_least"]) for x in tail_probabilities(spark.createDataFrame(rows, "g string, v bigint"), ["g"], "v", small).collect()}
        for (g, v), (most, least) in got.items():
            own = sorted(x for h, x in rows if h == g)
            assert most == pytest.approx(bisect_right(own, v) / len(own)) and least == pytest.approx(1 - bisect_left(own, v) / len(own))
        assert len(got) == len(set(rows))
    assert tail_probabilities(spark.createDataFrame([], "g string, v bigint"), ["g"], "v").count() == 0


def test_scores_tell_kinds_apart(spark):
    r = random.Random(5)
    rows, kinds = [], {}
    for i in range(400):
        kind = "not_prose" if i % 6 == 0 else "prose"
        rows.append((i, r.choice(KINDS[kind]) + ("\nIt is as it was." if kind == "prose" else ""), r.choice(["en", "EN-us", None, "xx"]), "clash"))
        kinds[i] = kind
    rows += [(900, None, "en", ""), (901, "  ", "en", ""), (None, PROSE, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row string")
    # One label in fifty is wrong, as labels are.
    said = [(i, kinds[i] if i % 50 != 7 else ("prose" if kinds[i] == "not_prose" else "not_prose")) for i in range(0, 400, 2)]
    labels = spark.createDataFrame([*said, (5, "not_prose"), (5, "prose"), (7, None), (None, "prose"), (4000, "prose")], "doc_id bigint, label string")
    both = [{x["doc_id"]: (x["score"], x["outlier"]) for x in outlier_scores(docs, labels, small).collect()} for small in (None, 0)]
    assert both[0].keys() == both[1].keys() == kinds.keys() and all(both[0][i] == pytest.approx(both[1][i]) for i in kinds)
    wrong = [i for i, k in kinds.items() if (both[0][i][0] > 0) != (k == "not_prose")]
    assert len(wrong) <= 4, wrong
    for given in (None, labels.where("false"), labels.where("label = 'prose'")):
        assert outlier_scores(docs, given).where("score is not null").isEmpty()
    assert document_statistics(docs).columns == ["doc_id", "language", *STATISTICS]
    assert outlier_scores(docs.where("false"), labels).count() == 0
    assert docs.select(F.max("doc_id")).first()[0] == 901


def test_a_language_of_mostly_logs(spark):
    """Ranks within a language cannot tell what most of it is from the rest; ranks among all documents do."""
    r = random.Random(7)
    log = lambda i: "".join(f"2024-05-{r.randrange(10, 29)} 10:{r.randrange(10, 60)}:00 the job {i} is not in the list of all that was done\n" for _ in range(r.randrange(3, 9)))
    for share in (60, 100):
        rows = [(i, log(i) if i % 100 < share else PROSE * r.randrange(1, 4) + MORE, "en") for i in range(400)]
        kinds = {i: i % 100 < share for i in range(400)}
        rows += [(i, "Wir wissen, dass der Plan nicht so gut ist, wie er war. " * r.randrange(1, 3), "de") for i in range(400, 800)]
        kinds |= {i: False for i in range(400, 800)}
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        labels = spark.createDataFrame([(i, "not_prose" if kinds[i] != (i % 50 == 3) else "prose") for i in range(800)], "doc_id bigint, label string")
        got = {x["doc_id"]: x["score"] > 0 for x in outlier_scores(docs, labels).collect()}
        assert sum(got[i] != k for i, k in kinds.items()) <= 8, (share, sum(got[i] != k for i, k in kinds.items()))
