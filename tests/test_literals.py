"""Texts a pattern needs: what is found, and that no match is ruled out."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from loomlog.functions.literals import required_texts
from loomlog.functions.patterns import search_match


@pytest.mark.parametrize(
    "pattern, texts",
    [
        (r"after [0-9]+ ms$", [["after "], [" ms"]]),
        (r"time(d )?out", [["timed out", "timeout"]]),
        (r"(error|warning): disk", [["error: disk", "warning: disk"]]),
        (r"(err.*x|warn[0-9])", [["err", "warn"]]),
        (r"(abc)+de?f", [["abc"], ["def", "df"]]),
        (r"(abc){2}x*", [["abc"]]),
        (r"a{0,3}b{1,}c", [["b"], ["c"]]),
        (r"\x41\x{42}\.c\t", [["AB.c\t"]]),
        (r"\bword\b", [["word"]]),
        (r"(?P<n>key)=(?:a|b)", [["key=a", "key=b"]]),
        (r"(?i)an[0-9]+: x", [[": "]]),
        (r"(?i)abc", []),
        (r"x|.*", []),
        (r"[abc]+", []),
        (r"", []),
        (r"\Qa.b\E", []),  # not read here
        (r"\p{Lu}foo\pL", [["foo"]]),
        (r"{x}{2,}y", [["{x"], ["}"], ["y"]]),
    ],
)
def test_required_texts(pattern, texts):
    assert sorted(required_texts(pattern)) == sorted(texts)


def random_pattern(rng, depth=3):
    atoms = ["a", "b", "ab", "c", ".", "[ab]", "[^a]", r"\.", r"\b", "^", "$", "é", r"\d", r"\x61"]
    if not depth:
        return rng.choice(atoms)
    kind = rng.randrange(5)
    one, two = (random_pattern(rng, depth - 1) for _ in range(2))
    if kind == 0:
        return f"({one}|{two})"
    if kind == 1:
        return f"(?:{one}){rng.choice(['*', '+', '?', '{2}', '{0,2}', '{1,}', '*?'])}"
    if kind == 2:
        return rng.choice(atoms) + rng.choice(["", "*", "+", "?"])
    return one + two


def test_no_match_is_ruled_out():
    rng = random.Random(11)
    texts = ["".join(rng.choices("abc.é1 ", k=rng.randrange(9))) for _ in range(400)]
    needing = 0
    for _ in range(3000):
        pattern = rng.choice(["", "", "(?i)"]) + random_pattern(rng)
        try:
            hits = pc.match_substring_regex(pa.array(texts), f"(?s){pattern}").to_pylist()
        except pa.ArrowInvalid:
            continue
        needed = required_texts(pattern)
        needing += bool(needed)
        for text, hit in zip(texts, hits):
            passes = all(any(t in text for t in some) for some in needed)
            assert passes or not hit, (pattern, needed, text)
    assert needing > 500


def test_the_test_stands_before_the_matcher(spark):
    rows = [(i, t) for i, t in enumerate(["request 17 took 12 ms", "took ms", "all took 5 ms, done", "", None])]
    logs = spark.createDataFrame(rows, "i int, body string")
    java = search_match(spark, F.col("body"), r"took [0-9]+ ms$")
    plan = plan_of(logs.where(java))
    condition = next(line for line in plan.split("\n") if "Condition" in line)
    assert condition.index("Contains(body") < condition.index("RLIKE") and "Contains(body#1, took )" in plan.replace("  ", " ")
    assert [r.i for r in logs.where(java).collect()] == [0]
    assert [r.i for r in logs.where(~java).collect()] == [1, 2, 3]
    arrow = search_match(spark, F.col("body"), r"took (?:[0-9]+ )+ms$")
    assert "CASE WHEN" in plan_of(logs.where(arrow))  # only texts that pass are handed on
    assert [r.i for r in logs.where(arrow).collect()] == [0]
    assert [r.i for r in logs.where(~arrow).collect()] == [1, 2, 3]
    handed = logs.select(F.col("i"), arrow.alias("hit")).collect()
    assert [r.hit for r in handed] == [True, False, False, False, None]
