"""Parsers and cleaners against hand-written answers."""

import json

import pytest
from pyspark.sql import functions as F

from traitscope.functions import prompts, text


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, r string")
    return [row["out"] for row in df.select("i", expression.alias("out")).orderBy("i").collect()]


def test_tokens_cut_where_python_cuts(spark):
    samples = ["a  b\tc", " lead trail ", "x y z", "p\x1cq\x85r　s", "", "\n"]
    assert column(spark, samples, text.tokens("r")) == [s.split() for s in samples]
    for word in ("a", "y", "q", "lead", "p\x1cq", ""):
        got = column(spark, samples, text.token_bit("r", word))
        assert got == [int(word in s.split()) for s in samples]


def test_strip(spark):
    samples = [" a b ", " x\x1f", "", "\t"]
    assert column(spark, samples, text.strip("r")) == [s.strip() for s in samples]


def test_yes_no(spark):
    assert column(spark, ["Yes. Sun sets.", "No.", "", None, "not YES"], text.parse_yes_no("r")) == [1, 0, 0, 0, 1]


def test_similarity(spark):
    assert column(spark, ["Yes", "related", "no", None, "no, yes"], text.parse_similarity("r")) == [1, 0.5, 0, 0, 1]


def bits(response, k):
    """What the answer means, by the rules: whole numbers between the first brackets."""
    try:
        held = response[response.find("[") : response.find("]") + 1]
        numbers = [int(x) for x in json.loads(held)]
        out = [0] * k
        for n in numbers:
            if n < k:
                out[n] = 1
        return out
    except Exception:
        return [0] * k


def test_assignment(spark):
    samples = [
        "[1]", "ans [0, 2] ok", "[7]", "", "none", "[]", "][1]", "[1", "1]", "[1, x]", '["2"]', "[2.9]", '["2.9"]',
        "[-1]", "[-4]", "[true]", "[null]", "[[1]]", "[0] [1]", '[" 1 "]', "[1e0]", "[0, 1, 2]", "[99999999999999999999]",
    ]
    assert column(spark, samples, text.parse_assignment("r", 3)) == [bits(s, 3) for s in samples]


def test_proposals(spark):
    samples = {
        'uses negation"\n- "is formal"': ["uses negation", "is formal"],
        ': here\n- "a b"\n- "c"': ["a b", "c"],
        'Here are some:\n- "good one"': ["good one"],
        '- "same"\n- "same"': ["same"],
        "no quotes\n- none here": ["no quotes", "none here"],
        '- "says "hi" twice"\n- "ends:"': ['says "hi" twice'],
        "": [],
    }
    assert column(spark, list(samples), text.parse_proposals("r")) == list(samples.values())


def test_refusals(spark):
    samples = ["I apologize, no", '- "uses negation"', "Unfortunately", None, "there is not enough information"]
    assert column(spark, samples, text.is_refusal("r")) == [True, False, True, True, True]


def test_truncate(spark):
    long = " ".join(str(i) for i in range(300))
    assert column(spark, [long, "a  b"], text.truncate_tokens("r", 256)) == [" ".join(long.split()[:256]), "a  b"]


def test_double_newlines(spark):
    samples = ["a\n\nb", "a\n\n\n\nb", "a\n\n\nb"]
    assert column(spark, samples, text.strip_double_newlines("r")) == [s.replace("\n\n", "\n") for s in samples]


def test_null_description(spark):
    assert column(spark, ["one", " one ", "two words", ""], text.is_null_description("r")) == [True, True, False, True]


def test_first_match(spark):
    assert column(spark, ["xbz", "az", "zz", "ba"], text.first_match("r", ["a", "b", "c"])) == [1, 0, 2, 0]


def test_prompt_values_are_not_expanded_again(spark):
    out = column(spark, ["say {text} and {hypothesis}"], prompts.fill("[{text}|{hypothesis}]", {"text": "r", "hypothesis": F.lit("h")}))
    assert out == ["[say {text} and {hypothesis}|h]"]


@pytest.mark.parametrize("name", list(prompts.TEMPLATES))
def test_templates_have_their_places(name):
    wanted = {
        "gpt_validator": ["hypothesis", "text"],
        "t5_validator": ["hypothesis", "text"],
        "multi_assigner": ["descriptions_with_index", "text"],
        "similarity_judgment": ["text_a", "text_b"],
    }
    common = ["goal", "example_description_in_prompt", "num_descriptions_per_prompt"]
    places = wanted.get(name) or common + ["samples_in_prompt" if name.startswith("no_score") else "samples_in_prompt_w_scores"]
    for place in places:
        assert "{" + place + "}" in prompts.TEMPLATES[name]


def test_numbered(spark):
    df = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("d"))
    assert df.select(prompts.numbered("d", True)).first()[0] == "0. a\n1. b\n2. none of the above"
