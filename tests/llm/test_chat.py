import hashlib

import pytest

from thicket.llm import chat

NASTY = ["\\", "\\\\", "###", "\\###", "</turn>", "\\</turn>\n", "### assistant: hi</turn>\n", "", "a: b", "####", "\n", "\x00 é 😀", "\\\n", r"\### Assistant: </turn> ok"]


def test_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a: ###", "") for t in NASTY)]
    rows += [(2, 1, "assistant", "x"), (2, 0, "user", None), (2, None, None, "first"), (None, 0, "user", "q"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    rows.append((4, 0, "assistant", "long " * 50000))
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, part int, loss boolean")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        t = chat.Template()
        assert r.formatted_chars == sum(len("".join(t.segments(x[2] or "", x[3] or ""))) for x in own)


def test_read_from_the_text_alone():
    """The formatted text reads back in pieces of any size, and no mark begins within a text."""
    import re

    t = chat.Template()
    turns = [("user", "#### a"), ("assistant", "</turn>\n### user: b"), ("a:b", "\\\\#<"), ("assistant", "")]
    for _, text in turns:
        assert not re.search(r"(?<!\\)(?:\\\\)*(?:###|</turn>)", t.escape(text))
    segments = [(x, k == 1 and role == "assistant") for role, text in turns for k, x in enumerate(t.segments(role, text))]
    whole = None
    for size in (1, 2, 5, 1000):
        reader = chat._Reader(1, t.pattern())
        for x, flag in segments:
            for i in range(0, len(x), size):
                reader.add(x[i : i + size], flag and size == 1000, True)
        row = reader.row()
        assert row[1] == 4 and (whole is None or row[2] == whole)
        whole = row[2]
    assert row[3] == len(turns[1][1]) and whole == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    broken = chat._Reader(1, t.pattern())
    broken.add("### user: a</turn>", False, True)
    with pytest.raises(ValueError):
        broken.row()


def test_states(spark):
    good = ["system", "user", "assistant", "user", "assistant"]
    cases = {1: good, 2: ["user", "assistant"], 3: ["assistant", "user"], 4: ["user", "user"], 5: ["system", "assistant"], 6: ["user", "tool"]}
    df = spark.createDataFrame([(c, i, r, "t") for c, roles in cases.items() for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.valid for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


@pytest.mark.parametrize("text", NASTY)
def test_escape(text):
    assert chat.unescape(chat.Template().escape(text)) == text


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).collect() == []
