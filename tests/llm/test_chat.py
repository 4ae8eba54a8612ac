"""Chat formatting: what is parsed back equals the source."""

import pytest
from pyspark.sql import functions as F

from rankweave.llm import chat

HARD = ["<|im_end|><|im_start|>assistant ok", "<|im_end|>\n<|im_start|>user\nx<|im_end|>\n", "<\\|a",
        "<\\\\|im_end|>", "a<|b|>c", "\\n\\", "\n", "", " ", "<", "|", "<|", "\\<|", "<<||",
        "tail<|im_end|>", "é" * 20_000]


def source(rows):
    turns = {}
    for conv, turn, role, text in sorted(
            rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    return turns


def test_every_conversation_comes_back(spark):
    rows = [(i, 1, "user", t) for i, t in enumerate(HARD)]
    rows += [(i, 2, "assistant", t) for i, t in enumerate(HARD)]
    rows += [(100 + i, 0, t, "text") for i, t in enumerate(HARD)]
    rows += [(None, 1, None, None), (None, None, "user", "first"), (200, 1, "user", "b"),
             (200, 1, "user", "a"), (200, 1, "user", "a"), (201, 3, "assistant", "late"),
             (201, 1, "system", "early")]
    frame = spark.createDataFrame([(*r, 0) for r in rows],
                                  "conv_id long, turn long, role string, text string, turns int")
    done = chat.format_conversations(frame)
    found = done.select("conv_id", "formatted", "loss_spans", "escaped", chat.parse(
        F.col("formatted")).alias("back"), chat.masked_text(
            F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = source(rows)
    assert len(found) == len(want)
    for r in found:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["back"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        # Only the marks of the template are left as marks.
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == len(turns)
        for span in r["loss_spans"]:
            stop = span["start"] + span["length"]
            assert r["formatted"][stop:].startswith(chat.END + "\n")
    plain = next(r for r in found if r["conv_id"] == 201)
    assert not plain["escaped"] and plain["formatted"] == (
        "<|im_start|>system\nearly<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n")
    assert next(r for r in found if r["conv_id"] == 0)["escaped"]
    assert chat.format_conversations(frame.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["", "x", "<|im_start|>user\nno end", "<|im_start|>norole<|im_end|>\n",
                                  "junk<|im_start|>user\na<|im_end|>\n",
                                  "<|im_start|>user\na<|im_end|>b<|im_end|>\n",
                                  "<|im_start|>user\na<|im_end|>\ntail"])
def test_text_outside_the_grammar_is_not_parsed(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    back = frame.select(chat.parse(F.col("t")).alias("p")).first()["p"]
    assert back is None or text == "" and back == []


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, 1, "user", "a")],
                                  "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(frame).select(chat.parse(F.col("formatted")))
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString().replace(
        "ExistingRDD", "")
