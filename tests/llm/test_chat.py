import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logspark.llm.chat import TOKENIZER, Template, chat_digests, codec, format_chats, read_loss, read_turns

TEMPLATE = Template()
MARKED = "</s>[INST] ok [/INST]"
PIECES = st.lists(st.sampled_from(["<", "/", "s>", "\\", "[", "INST]", "</s>", "<s>", "[/INST]", "é", " ", "\n"])).map("".join)


@given(PIECES)
@settings(max_examples=400, deadline=None)
def test_escape_is_reversible(text):
    escaped = TEMPLATE.escape(text)
    assert TEMPLATE.unescape(escaped) == text
    assert not any(mark in escaped for mark in TEMPLATE.marks)


def test_unsuited_marks():
    with pytest.raises(ValueError):
        Template(open="<<x")


TURNS = [
    (1, 0, "user", MARKED, "x"),
    (1, 1, "assistant", MARKED, "x"),
    (2, 1, "assistant", "second", "x"),
    (2, 0, "user", None, "x"),
    (2, 1, "assistant", "a tie, by role and hash", "x"),
    (2, None, None, "first of all", "x"),
    (3, 0, "assistant", "", "x"),
    (3, 1, "assistant", "one\u2028two <\\/s> \\</s> 日本 \U0001f600", "x"),
    (3, 2, "[INST]", " " * 5000 + "end", "x"),
    (None, 0, "user", "no id", "x"),
    (4, 5, "user", "same", "x"),
    (4, 5, "user", "same", "x"),
    (5, 0, "assistant", "long " * 60_000, "x"),
]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")


@pytest.mark.parametrize("block_chars", [1 << 20, 10])
def test_round_trip(spark, block_chars):
    made = format_chats(conversations(spark, TURNS), block_chars=block_chars)
    coder = codec(TOKENIZER, TEMPLATE)
    blocks = sorted(made.collect(), key=lambda r: (str(r.conv_id), r.block))
    for conv in {t[0] for t in TURNS}:
        own = [b for b in blocks if b.conv_id == conv]
        turns, loss = [], ""
        for b in own:
            ids, mask = np.array(b.ids, np.int32), np.array(b.loss_mask, np.int8)
            assert coder.decode(ids) == b.formatted and len(ids) == len(mask)
            turns += read_turns(ids, coder, TEMPLATE)
            loss += "".join(read_loss(ids, mask, coder, TEMPLATE))
        want = [t for t in TURNS if t[0] == conv]
        assert sorted(turns) == sorted((t[2] or "", t[3] or "") for t in want)
        if len({t[1] for t in want}) == len(want):
            ordered = sorted(want, key=lambda t: -1 if t[1] is None else t[1])
            assert turns == [(t[2] or "", t[3] or "") for t in ordered]
        assert loss == "".join(text for role, text in turns if role == "assistant")
    digests = {r.conv_id: r for r in chat_digests(made).collect()}
    assert len(digests) == len({t[0] for t in TURNS})
    one = digests[1]
    assert one.turns_sha256 == hashlib.sha256(f"user\n{MARKED}\nassistant\n{MARKED}\n".encode()).hexdigest()
    assert (one.n_turns, one.loss_chars) == (2, len(MARKED))
    assert one.loss_sha256 == hashlib.sha256(MARKED.encode()).hexdigest()
    assert digests[3].loss_chars == len(TURNS[7][3])
    assert one.formatted_chars == sum(len(b.formatted) for b in blocks if b.conv_id == 1)


def test_no_rows(spark):
    assert chat_digests(format_chats(conversations(spark, []))).collect() == []


def test_long_texts_have_the_ids_of_the_whole():
    coder = codec(TOKENIZER, Template())
    rng = random.Random(6)
    parts = ["word", "Wörter", " ", "  ", "\n", "\n\n ", "12", "it's", "!?", "\t", "日本語", "x" * 50_000, " " * 500, "\x1c", "\xa0", "\u3000"]
    for _ in range(20):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2_000, 60_000)))[:400_000]
        assert coder.encode(text) == coder._encoding_of_text(text)
    for text in (" " * 300_000, "a" + "\n" * 250_000 + "b", "!" * 250_000):
        assert coder.decode(np.array(coder.encode(text))) == text
