import pytest
from pyspark.sql import functions as F

from noonward.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "</turn>\n", "<turn>assistant\n", "<\\/turn>", "<\\\\/turn>\\", "\\### Assistant: </turn> ok", "a\nb", "<", "%25 %0A <turn", "</turn"]


def test_escape_is_reversible_and_hides_controls(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "text string")
    rows = df.select("text", chat.escaped("text").alias("e")).select("*", chat.unescaped("e").alias("back")).collect()
    assert all(r.back == r.text and "<turn" not in r.e and "</turn" not in r.e for r in rows)


def said(spark, rows):
    return {r.conv_id: r for r in chat.read_back(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_every_reply_is_an_example(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b")]
    made = chat.expand(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert [r.text for r in made] == [
        "<turn>system\ns</turn>\n<turn>user\nu</turn>\n<turn>assistant\na</turn>\n",
        "<turn>system\ns</turn>\n<turn>user\nu</turn>\n<turn>assistant\na</turn>\n<turn>user\nv</turn>\n<turn>assistant\nb</turn>\n",
    ]
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in made] == ["a", "b"]
    assert [(r.example, r.n_turns, r.is_last) for r in made] == [(1, 3, False), (2, 5, True)]


def test_turns_after_the_last_reply_stay(spark):
    rows = [(1, 0, "assistant", "a"), (1, 1, "user", "u"), (2, 0, "user", "only")]
    back = said(spark, rows)
    assert [tuple(t) for t in back[1].turns] == [("assistant", "a"), ("user", "u")] and back[1].trained == ["a"]
    assert [tuple(t) for t in back[2].turns] == [("user", "only")] and back[2].trained == []


def test_nasty_texts_and_roles(spark):
    rows = [(1, i, role, t) for i, t in enumerate(NASTY) for role in ("assistant", "us\ner%0A<")]
    back = said(spark, rows)[1]
    want = sorted((i, role, t) for _, i, role, t in rows)
    assert [tuple(t) for t in back.turns] == [w[1:] for w in want]
    assert back.trained == NASTY


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", None), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "assistant", "x")]
    back = said(spark, rows)
    assert [tuple(t) for t in back[None].turns] == [("", ""), ("assistant", "")] and back[None].trained == [""]
    assert [tuple(t) for t in back[3].turns] == [("assistant", "x"), ("user", "a"), ("user", "a"), ("user", "b")]


def test_empty_table_extra_columns_and_long_text(spark):
    assert chat.expand(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "assistant", "y<" * 200_000, "mine", "mine")], SCHEMA + ", example string, heads string")
    back = chat.read_back(chat.expand(df)).first()
    assert back.trained == ["y<" * 200_000]


@pytest.mark.parametrize("n", [120])
def test_long_conversation(spark, n):
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    back = chat.read_back(chat.expand(df)).first()
    assert back.trained == [str(i) for i in range(1, n, 2)] and len(back.turns) == n
