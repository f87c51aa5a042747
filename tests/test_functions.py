from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairmine.functions import arrays as ar
from pairmine.functions import chat
from pairmine.functions import preference as pf
from pairmine.functions import text as tx
from pairmine.functions import vectors as vc

SLOW = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    "text, word",
    [
        (' The answer is "Echo."', "Echo"),
        ("a b!", "b"),
        ("l'eau (x)", "x"),
        ("", ""),
        ("...", ""),
        (" \t\n", ""),
        ("one two ", "two"),
        ("ends with\x1cseparator", "separator"),
        ("über Straße.", "Straße"),
        ("smile 😀!", "😀"),
    ],
)
def test_last_word(spark, text, word):
    assert values(spark, tx.last_word(F.col("t")), [(text,)], "t string") == [word]


@SLOW
@given(st.lists(st.text(max_size=30).filter(lambda t: "\x00" not in t), min_size=1, max_size=20))
def test_last_word_is_the_last_split_token(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)]
    expected = [(t.split()[-1].strip(".,;:!?\"'()[]{}<>") if t.split() else "") for t in texts]
    if texts:
        assert values(spark, tx.last_word(F.col("t")), [(t,) for t in texts], "t string") == expected


def test_last_word_of_a_long_text_without_spaces(spark):
    df = spark.createDataFrame([("x" * 300_000 + " end",), ("y" * 300_000,)], "t string")
    assert [len(r[0]) for r in df.select(tx.last_word(F.col("t"))).collect()] == [3, 300_000]


@pytest.mark.parametrize(
    "output, prompt, rest",
    [
        ("say hi: hello", "say hi:", "hello"),
        ("say hi: say hi: hello", "say hi:", "say hi: hello"),
        ("well, say hi: hello say hi:", "say hi:", "well,  hello"),
        ("hello ", "say hi:", "hello"),
        ("hello", "", "hello"),
        ("a+b", "+", "ab"),
    ],
)
def test_strip_prompt_echo(spark, output, prompt, rest):
    column = tx.strip_prompt_echo(F.col("o"), F.col("p"))
    assert values(spark, column, [(output, prompt)], "o string, p string") == [rest]


def test_format_ok(spark):
    rows = [("ice cream",), ("well-being",), (" tree ",), ("two_words",), ("  ",), ("a\tb",)]
    assert values(spark, tx.format_ok(F.col("w")), rows, "w string") == [False, False, True, True, False, True]


def test_fixed_length_ids(spark):
    rows = [([1, 2],), ([],), ([1, 2, 3, 4, 5, 6],)]
    ids = F.col("ids")
    got = {
        s: values(spark, ar.fixed_length_ids(ids, 5, 0, s), rows, "ids array<bigint>") for s in ar.SIDES
    }
    assert got["left"] == [[0, 0, 0, 1, 2], [0] * 5, [1, 2, 3, 4, 5]]
    assert got["right"] == [[1, 2, 0, 0, 0], [0] * 5, [1, 2, 3, 4, 5]]
    masks = {s: values(spark, ar.fixed_length_mask(ids, 5, s), rows, "ids array<bigint>") for s in ar.SIDES}
    assert masks["left"] == [[0, 0, 0, 1, 1], [0] * 5, [1] * 5]
    assert masks["right"] == [[1, 1, 0, 0, 0], [0] * 5, [1] * 5]
    with pytest.raises(ValueError):
        ar.fixed_length_ids(ids, 5, 0, "middle")


def test_prompt_length_differs_when_the_pad_id_is_in_the_text(spark):
    rows = [([9, 9, 5, 9, 7], [0, 0, 1, 1, 1])]
    schema = "ids array<bigint>, mask array<int>"
    ids, mask = F.col("ids"), F.col("mask")
    assert values(spark, ar.prompt_length(ids, mask, 9, "left"), rows, schema) == [2]
    assert values(spark, ar.prompt_length(ids, mask, 9, "right"), rows, schema) == [3]


def test_l2_normalise(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],)]
    got = values(spark, vc.l2_normalise(F.col("v")), rows, "v array<float>")
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, vc.dot(F.col("v"), F.col("v")), rows, "v array<float>") == [25.0, 0.0]


def test_round6_has_no_negative_zero(spark):
    (got,) = values(spark, vc.round6(F.col("x")), [(-1e-9,)], "x double")
    assert math.copysign(1, got) == 1


def test_sigmoid_loss(spark):
    rows = [(x,) for x in (-800.0, -1.0, 0.0, 1.0, 800.0)]
    got = values(spark, pf.dpo_loss(F.col("x"), "sigmoid", 1.0), rows, "x double")
    assert [round(x, 6) for x in got] == [800.0, 1.313262, 0.693147, 0.313262, 0.0]


def test_hinge_loss(spark):
    got = values(spark, pf.dpo_loss(F.col("x"), "hinge", 0.1), [(0.0,), (10.0,), (20.0,)], "x double")
    assert got == [1.0, 0.0, 0.0]


def test_unknown_loss():
    with pytest.raises(ValueError):
        pf.dpo_loss(F.lit(0.0), "ipo")


def test_sequence_logp(spark):
    rows = [([-1.0, -2.0, -4.0], [0, 1, 1]), ([], [])]
    column = pf.sequence_logp(F.col("l"), F.col("m"))
    assert values(spark, column, rows, "l array<double>, m array<int>") == [-6.0, 0.0]


def test_render_chat(spark):
    schema = "m array<struct<role:string,text:string>>, raw string"
    rows = [
        ([("user", "Hi")], "Hi"),
        ([("system", "Be brief"), ("user", "Hi")], "x"),
        ([("tool", "?")], "raw one"),
        ([], "raw two"),
        ([("user", None)], "raw three"),
    ]
    got = values(spark, chat.render_chat(F.col("m"), F.col("raw")), rows, schema)
    assert got[0] == "<|user|>\nHi<|end|>\n<|assistant|>\n"
    assert got[1] == "<|system|>\nBe brief<|end|>\n<|user|>\nHi<|end|>\n<|assistant|>\n"
    assert got[2:] == ["raw one", "raw two", "raw three"]
