import random

from hypothesis import given, settings, strategies as st

from memloom.llm.splitting import first_line, split_text, split_units

TEXT = st.lists(st.sampled_from(["a", "bc ", ". ", "\n", "\n\n", "\r\n", "。", "é", "é", "\U0001f468‍\U0001f469", " ", ","]), max_size=400).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.sampled_from([(40, 0), (40, 7), (60, 20)]))
def test_pieces_rebuild_the_text(text, sizes):
    limit, overlap = sizes
    parts = split_text(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in parts) and parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(n[0] == p[1] - overlap for p, n in zip(parts, parts[1:]))
    assert len(parts) == 1 if len(text) <= limit else len(parts) > 1


def test_cuts_at_the_strongest_boundary_near():
    para = "one sentence here. " * 6
    text = (para.strip() + "\n\n") * 12
    assert {k for _, _, k in split_text(text, 300, 20)} == {"paragraph", "end"}
    assert {k for _, _, k in split_text(para * 10, 300, 20)} == {"sentence", "end"}
    assert {k for _, _, k in split_text("word " * 300, 300, 20)} == {"word", "end"}
    assert {k for _, _, k in split_text("x" * 1000, 300, 20)} == {"none", "end"}
    lengths = [b - a for a, b, _ in split_text("x" * 1000, 300, 20)]
    assert max(lengths) - min(lengths) <= 1  # balanced, not one full piece after the other
    assert all(text[c - 2 : c] == "\r\n" for text in ["ab\r\n" * 400] for _, c, k in split_text(text, 300, 20) if k != "end")


def test_very_long_text_is_quick():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdef") for _ in range(6)) + r.choice([".", ""]) for _ in range(200_000))
    parts = split_text(text)
    assert max(b - a for a, b, _ in parts) <= 3000 and len(parts) < 600


def test_first_line():
    assert [first_line(*x) for x in ((5, 9, 5), (9, 5, 5), (None, 9, 5), (None, 2, 5), (None, None, 5), (4, None, 5), (0, 3, 2))] == [5, 5, 5, 1, None, 4, 1]


def test_units(spark):
    long = "line of words here.\n" * 400
    rows = [("u", "h", long, 11, 410, 1), ("u", "h", long, 11, 410, 2), ("u", "h2", "x" * 3001, 9, 3, 1), ("v", None, "y" * 4000, None, None, 1), ("s", "h", "short", 1, 1, 1), ("n", "h", None, 1, 1, 1), ("e", "h", "", 1, 1, 1), ("x", "h", "\U0001f600" * 3000, 1, 1, 1)]
    df = spark.createDataFrame(rows, "id string, content_sha string, text string, lineno int, line_end int, pieces int")
    got = split_units(df).orderBy("id", "content_sha", "piece_no").collect()
    assert {(r["id"], r["content_sha"]) for r in got} == {("u", "h"), ("u", "h2"), ("v", None)}
    mine = [r for r in got if r["content_sha"] == "h"]
    assert "".join(r["text"] if r["piece_no"] == 1 else r["text"][200:] for r in mine) == long
    assert mine[0]["line_start"] == 11 and mine[-1]["line_end"] == 410 and all(r["line_end"] - r["line_start"] <= 151 for r in mine)
    assert {r["line_start"] for r in got if r["id"] == "v"} == {None} and {r["line_end"] for r in got if r["content_sha"] == "h2"} == {3}
    assert split_units(df.where("false")).count() == 0
