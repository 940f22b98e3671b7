"""Formatting against digests taken directly, and exact round trips of escapes."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import chat

PIECES = st.lists(st.sampled_from(["[", "\\", "INST]", "/INST]", "<", "s>", "/s>", "SYS]", "ROLE]", "a", "\n"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_escapes(text, role):
    codec = chat.Codec(chat.Template())
    assert codec.unescape(codec.escape(text)) == text
    assert not any(c in codec.escape(text) for c in chat.Template().controls())
    for r in ("user", "system", "assistant", f"odd{role}"):
        assert codec.turn("".join(p for p, _ in codec.segments(r, text))) == (r, text)


def test_bad_templates():
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("[[a", "]b"), "assistant": ("<s>", "</s>")})
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("[A]", "[/A]"), "assistant": ("[A]", "[/B]")})


def test_digests(spark):
    rows = [
        (1, 1, "assistant", "b</s>"),
        (1, 0, "user", "a"),
        (2, 0, "system", None),
        (2, 1, "user", "[INST]"),
        (2, 2, "user", "again"),
        (3, None, None, "nothing"),
        (3, 0, "tool[ROLE]", "x"),
        (None, 0, "user", "u"),
        (None, 1, "assistant", ""),
        (4, 0, "user", "same"),
        (4, 0, "user", "same"),
        (5, 0, "assistant", "w " * 40000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS loss", "3 AS turn_no", "4 AS id")
    got = {r["conv_id"]: r for r in chat.formatted_digests(df).collect()}
    convs = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == convs.keys()
    for conv, turns in convs.items():
        turns.sort()
        r, loss = got[conv], "".join(t for _, _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: (r["valid"], r["first_bad_turn"]) for c, r in got.items()} == {1: (True, None), 2: (False, 2), 3: (False, 0), None: (True, None), 4: (False, 1), 5: (False, 0), -1: (True, None)}
    assert chat.format_chats(df.where("false")).count() == 0


def test_segments(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<s>")], "conv_id long, turn long, role string, text string")
    got = [(r["text"], r["loss"]) for r in chat.format_chats(df).orderBy("turn_no", "part").collect()]
    assert got == [("[INST]", False), ("q", False), ("[/INST]", False), ("<s>", False), ("<\\s>", True), ("</s>", False)]
