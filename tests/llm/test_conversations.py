import datetime as dt
import json

from memloom.llm.conversations import message_paths, rebuild_conversations

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "message_id bigint, conv_id string, seq int, role string, content string, sent_at timestamp, received_at timestamp, pos int"


def rows(conv, said, numbered=True, start=1, first_id=0):
    return [(first_id + i, conv, start + i if numbered else None, role, text, T0 + dt.timedelta(minutes=i), T0, 7) for i, (role, text) in enumerate(said)]


def test_what_is_kept(spark):
    talk = [("User ", "hi"), ("assistant:", "yes"), (" HUMAN :", "?"), ("Bot", "-")]
    block = lambda *x: json.dumps([{"type": "text", "text": t} if t is not None else {"type": "image"} for t in x])
    data = []
    add = lambda name, *a, **k: data.extend(rows(name, *a, first_id=1000 * len({r[1] for r in data}), **k))
    add("plain", talk)
    add("timed", talk, numbered=False)
    add("system", [("system", "s"), ("developer", "d"), *talk])
    add("blocks", [("user", block("a", None)), ("model", "[not json"), ("user", "[x](y)"), ("ai", block(None, "b"))])
    add("gap", talk[:2] + [("x", "x")] + talk[2:])
    data[-3] = (*data[-3][:2], 99, *data[-3][3:])
    add("starts_at_2", talk, start=2)
    add("starts_at_0", talk, start=0)
    add("ends_with_user", talk[:3])
    add("only_system", [("system", "s")])
    add("two_users", [talk[0], talk[0], talk[1], talk[1]])
    add("late_system", [talk[0], talk[1], ("system", "s")])
    add("unknown", [talk[0], ("tool", "x")])
    add("no_role", [talk[0], (None, "x")])
    add("blank", [talk[0], ("assistant", " \n ")])
    add("null_text", [talk[0], ("assistant", None)])
    add("empty_blocks", [talk[0], ("assistant", "[]")])
    add("image_only", [talk[0], ("assistant", block(None))])
    add("blank_block", [talk[0], ("assistant", block("  "))])
    add("some_null_seq", talk)
    data[-1] = (*data[-1][:2], None, *data[-1][3:])
    add("repeated_seq", talk)
    data[-1] = (*data[-1][:2], 3, *data[-1][3:])
    add("long", talk[:2] * 40)
    again = [(*r[:6], T0 + dt.timedelta(days=1), 7) for r in data[:3]]
    odd = [(None, "plain", 5, "user", "x", T0, T0, 7), (999999, None, 1, "user", "x", T0, T0, 7)]
    df = spark.createDataFrame(data + again + odd, SCHEMA)
    got = [tuple(r) for r in rebuild_conversations(df).collect()]
    kept = {"plain", "timed", "system", "blocks", "long"}
    assert {c for c, _, _ in got} == kept and len(got) == len(set(got))
    by = {(r[1], r[0]): i for c in kept for i, r in enumerate([x for x in data if x[1] == c], 1)}
    assert {(c, m): p for c, p, m in got} == by
    full = {(r["conv_id"], r["pos"]): (r["role"], r["content"]) for r in rebuild_conversations(df, with_content=True).collect()}
    assert full["blocks", 4] == ("assistant", "b") and full["plain", 3] == ("user", "?")
    assert rebuild_conversations(df.where("false")).count() == 0


def test_ties_in_time(spark):
    data = [(3, "c", None, "assistant", "b", T0, T0, 0), (1, "c", None, "user", "a", T0, T0, 0)]
    assert [tuple(r) for r in rebuild_conversations(spark.createDataFrame(data, SCHEMA)).orderBy("pos").collect()] == [("c", 1, 1), ("c", 2, 3)]


def test_true_parent_pointers(spark):
    """A circle, an orphan, a fork and a thread across conversations, by pointers that say so."""
    said = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    up = {"good": [None, 0, 1, 2], "circle": [3, 0, 1, 2], "orphan": [None, 0, 77, 2], "fork": [None, 0, 1, 1], "selfish": [None, 0, 1, 3], "two": [None, 0, None, 2]}
    data = []
    for c, (conv, parents) in enumerate(up.items()):
        data += [(100 * c + i, conv, None, role, text, T0 - dt.timedelta(minutes=i), T0, None if p is None else 100 * c + p) for i, ((role, text), p) in enumerate(zip(said, parents))]
    df = spark.createDataFrame(data, SCHEMA.replace("pos int", "parent_id bigint"))
    assert sorted(map(tuple, rebuild_conversations(df, parent="parent_id").collect())) == [("good", i + 1, i) for i in range(4)]


def test_paths_of_a_tree(spark):
    links = [(1, None), (2, 1), (3, 1), (4, 3), (5, 4), (10, None), (11, 10), (20, 21), (21, 20), (30, 99), (None, 1), (11, 10)]
    got = sorted(map(tuple, message_paths(spark.createDataFrame(links, "message bigint, parent bigint")).collect()))
    assert got == [(2, 1, 1), (2, 2, 2), (5, 1, 1), (5, 2, 3), (5, 3, 4), (5, 4, 5), (11, 1, 10), (11, 2, 11)]
