from hashlib import sha256

import numpy as np
import pytest

from casemill.llm import chat_format
from casemill.llm.chat_format import Template, digest_chats, escape, format_chats, op13, unescape

SCHEMA = "conv_id long, turn long, role string, text string, block string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "\\\\</s>\\", "", None, "<<SYS>><</SYS>>", "é<s>ü\\n", "<|role|>x<|text|>y<|end|>\n", "<" * 5 + "s>", "[INST", "\n"]


def brute(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = {}
    for conv, turns in out.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        got[conv] = (len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return got


def made():
    r = np.random.RandomState(1)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, int(turn), str(r.choice(["system", "user", "assistant", "assistant", "tool", "<s>\\"])), NASTY[r.randint(len(NASTY))], "x"))
    rows += [(3, None, "user", "first", "x"), (3, None, "user", "first", "x"), (4, 2, None, "no role", "x"), (5, 1, "assistant", "tie", "x"), (5, 1, "assistant", "tie", "x"), (6, 0, "a\nb", "z", "x"), (7, 0, "assistant", "long \\ </s> é" * 3000, "x")]
    return rows


def compare(got, rows):
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


@pytest.mark.parametrize("many,piece", [(1000, 4 << 20), (4, 4 << 20), (1000, 40), (4, 40)])
def test_digests(spark, monkeypatch, many, piece):
    monkeypatch.setattr(chat_format, "PIECE_BYTES", piece)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    compare(digest_chats(df, many=many).collect(), rows)


def test_text_and_mask(spark):
    rows = [(1, 0, "system", "be kind", ""), (1, 1, "user", "hi [INST]", ""), (1, 2, "assistant", "a</s>é", ""), (1, 3, "tool", "42", ""), (2, 5, "assistant", "", "")]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == "<<SYS>>\nbe kind\n<</SYS>>\n[INST] hi [\\INST] [/INST]\n<s>a<\\/s>é</s>\n<|role|>tool<|text|>42<|end|>\n"
    assert [got[1].text[s.start : s.end] for s in got[1].loss] == ["a<\\/s>é"]
    assert (got[2].text, [tuple(s) for s in got[2].loss]) == ("<s></s>\n", [(3, 3)])


def test_parts_are_the_whole(spark, monkeypatch):
    rows = [(7, i, "user" if i % 2 else "assistant", f"turn {i} " + "é" * (i % 30), "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = format_chats(df).collect()
    monkeypatch.setattr(chat_format, "PIECE_BYTES", 500)
    cut = format_chats(df, many=100).collect()
    assert len(whole) == 1 and len(cut) > 100 and len({r.block for r in cut}) > 50
    cut.sort(key=lambda r: (r.block, r.part))
    assert "".join(r.text for r in cut) == whole[0].text and sum(r.n_turns for r in cut) == 3000
    compare(digest_chats(df, many=100).collect(), rows)


def test_escape_is_reversible():
    r, t = np.random.RandomState(0), Template()
    bits = ["\\", "<", "s>", "/s>", "</s>", "[INST]", "[/", "INST]", "é", "<|end|>", "a", "<<SYS>>"]
    texts = ["".join(bits[i] for i in r.randint(len(bits), size=r.randint(12))).encode() for _ in range(3000)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    data, at = escape(np.frombuffer(b"".join(texts), np.uint8), off, t)
    for a, b in zip(at[:-1], at[1:]):
        assert not any(c.encode() in data[a:b].tobytes() for c in t.controls())
    back, again = unescape(data, at)
    assert back.tobytes() == b"".join(texts) and (again == off).all()


@pytest.mark.parametrize("named", [(("user", "<u>", "</u"), ("assistant", "<a>", "u</a>")), (("user", "x", "</u>"),), (("user", "<u>\\", "</u>"),), (("user", "<u>", "<u>"),), (("user", "<u>", ">x</u>"), ("b", "<u", "</v>"))])
def test_templates_that_cannot_be_read_back(named):
    with pytest.raises(ValueError):
        Template(named=named)


def test_own_template(spark):
    t = Template(named=(("user", "<|im_user|>\n", "<|im_end_user|>\n"), ("assistant", "<|im_bot|>\n", "<|im_end_bot|>\n")), other=("<|im_start|>", "<|im_sep|>\n", "<|im_end|>\n"))
    rows = made() + [(50, 0, "user", "<|im_bot|>", "x")]
    compare(digest_chats(spark.createDataFrame(rows, SCHEMA), template=t).collect(), rows)


def test_empty_and_planted(spark):
    assert digest_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    got = {r.conv_id: r for r in op13(spark, "/root/testdata/sf0.001").collect()}
    said = chat_format.PLANTED
    assert got[-1].loss_chars == len(said) and got[-1].loss_sha256 == sha256(said.encode()).hexdigest()
    assert got[-1].turns_sha256 == sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
