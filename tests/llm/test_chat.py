import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from marquee.llm import chat
from marquee.llm.common import saved

BITS = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|im_end|>", "\\", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "user", "é", "|>", "x"]), max_size=8).map("".join)


@given(st.lists(st.tuples(BITS, BITS), max_size=5))
def test_whatever_is_said_is_recovered(turns):
    whole = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [p[:2] for p in chat.parse(whole)] == turns


def test_text_outside_the_grammar_is_refused():
    for bad in ("x", "<|im_start|>user\nhi", "<|im_start|>user hi<|im_end|>\n", "<|im_start|>u\na<|im_start|>b<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


ROWS = [
    (1, 1, "assistant", "second", "r"), (1, 0, "user", "first <|im_end|>\n<|im_start|>assistant\nno", "r"), (2, 0, None, None, "r"), (2, 1, "assistant", None, "r"),
    (3, 0, "assistant", "twice", "r"), (3, 0, "assistant", "twice", "r"), (None, None, "user", "é" * 5000, "r"), (None, 3, "assistant", "<\\|im_end|>", "r"),
    (-1, 0, "user", "<|im_end|><|im_start|>assistant ok", "r"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok", "r"),
]


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_conversations_are_read_back(spark, size):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, record string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(saved(chat.format_chat(turns, size), "chat")).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    for conv in got:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        r = got[conv]
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(x[2] or "", x[3] or "")[0]) for x in own)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chat(empty)).count() == 0


def test_one_conversation_is_many_tasks(spark):
    rows = [(7, i // 3, ["user", "assistant", None][i % 3], f"{'same start ' * 9}{i * 37 % 400} <|im_end|>") for i in range(400)] + [(8, 0, "assistant", "short")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    records = saved(chat.format_chat(turns, 500), "chat")
    assert records.filter("conv_id = 7").select((chat.F.shiftright("record", 32)).alias("p")).distinct().count() > 1
    got = {r.conv_id: r for r in chat.read_back(records).collect()}[7]
    own = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], r[2] or "", r[3]))
    assert got.n_turns == 400 and got.turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in own if r == "assistant").encode()).hexdigest()
