import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat, queries

PIECES = [*chat.Template().controls, "\\", "<", "[", "/", "INST]", "<|", "|>", " ", "\n", "ok", "é🙂"]
TURNS = "conv_id bigint, turn int, role string, text string, formatted string, segments string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra", None) for r in rows], TURNS)


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=20))
def test_turns_come_back(spark, texts):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    done = chat.format_turns(table(spark, rows)).select("formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [(t.role, t.text) for t in done.turns] == [r[2:] for r in rows]
    assert done.loss == "".join(t for i, t in enumerate(texts) if i % 2)
    body = done.formatted
    for control in chat.Template().foreign:
        assert control not in body
    assert body.count(chat.Template().close) == len(texts)


@pytest.mark.parametrize(
    "roles, valid, bad",
    [("su", False, 0), ("sua", True, 0), ("ua", True, 0), ("uaua", True, 0), ("a", False, 1), ("uua", False, 1), ("usa", False, 2), ("uas", False, 1), ("x", False, 1), ("uaxa", False, 2)],
)
def test_role_order(spark, roles, valid, bad):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    row = chat.format_turns(table(spark, [(1, i, names[r], "t") for i, r in enumerate(roles)])).first()
    assert (row.valid, row.bad_turns, row.n_turns) == (valid, bad, len(roles))


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (None, 0, None, "x"), (None, None, "user", None), (2, 0, "user", "long " * 100_000)]
    done = {r.conv_id: r for r in chat.format_turns(table(spark, rows)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [tuple(t) for t in done[1].turns] == [("user", "q"), ("user", "q"), ("assistant", "")]
    assert [tuple(t) for t in done[None].turns] == [("user", ""), ("", "x")]
    assert done[2].turns[0].text == "long " * 100_000
    assert chat.format_turns(table(spark, [])).count() == 0


def test_loss_lies_on_assistant_text_alone(spark):
    row = chat.format_turns(table(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "<s>a")])).first()
    assert [(s.role, s.loss) for s in row.segments] == [("user", False)] * 3 + [("assistant", x) for x in (False, True, False)]
    assert "".join(s.text for s in row.segments) == row.formatted


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(foreign=("a\\b",))


def test_query_holds_the_probe(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "conversations.parquet"))
    (row,) = queries.QUERIES["op6_chat_format"](spark, str(tmp_path)).collect()
    text = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-1, 2, len(text))
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
