"""Sets of several kinds as columns."""

import re

import pytest
from pyspark.sql import functions as F

from graftline.functions import regular
from graftline.functions import typed_sets as T

iv = lambda *xs: F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for a, b in xs])
fin = lambda *xs: T.finite(F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>"))


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


def test_subset_across_kinds(value):
    ints, rx = T.integers(iv((1, 5), (10, None))), T.regex(F.lit("a*b?"))
    cases = [
        (fin("1", "12"), ints, True), (fin("7"), ints, False), (fin("x"), ints, False), (fin("aab"), rx, True), (fin("ba"), rx, False), (fin(), T.empty(), True), (fin("a"), T.empty(), False),
        (rx, T.regex(F.lit("[ab]*")), True), (T.regex(F.lit("[ab]*")), rx, False), (T.regex(F.lit("a|b")), fin("a", "b", "c"), True), (T.regex(F.lit("a*")), fin("a"), False),
        (T.integers(iv((2, 3))), ints, True), (ints, T.integers(iv((2, 3))), False), (T.integers(iv((2, 3))), fin("2", "3"), True), (T.integers(iv((2, None))), fin("2"), False),
        (T.integers(iv((2, 3))), T.regex(F.lit("[0-9]")), True), (rx, T.universal(), True), (T.universal(), ints, False), (T.universal(), T.integers(iv((None, None))), True), (T.empty(), rx, True),
    ]
    for i, (a, b, want) in enumerate(cases):
        assert value(T.subset(a, b)) == want, i
    assert value(T.equal(T.regex(F.lit("(ab)*")), T.regex(F.lit("(?:ab)*|ab")))) and value(T.is_empty(T.regex(F.lit(None).cast("string")))) and value(T.is_universal(T.regex(F.lit(r"(.|\n)*"))))


def test_operations_across_kinds(value):
    ints, rx = T.integers(iv((1, 5))), T.regex(F.lit("[ab]+"))
    shown = lambda s: value(T.text(s))
    assert shown(T.union(ints, fin("6", "9"))) == "1..6,9..9" and shown(T.union(fin("b"), fin("a"))) == "{a, b}" and shown(T.union(fin("b"), T.empty())) == "{b}"
    assert shown(T.intersection(fin("3", "7", "x"), ints)) == "{3}" and shown(T.intersection(rx, fin("ab", "c"))) == "{ab}" and shown(T.intersection(T.universal(), ints)) == "1..5"
    assert shown(T.difference(ints, fin("3", "x"))) == "1..2,4..5" and shown(T.difference(fin("ab", "c"), rx)) == "{c}" and shown(T.difference(T.universal(), ints)) == "-inf..0,6..inf"
    pattern = lambda s: value(s["pattern"])
    for s, words, others in ((T.union(rx, fin("c.d")), ["ab", "c.d"], ["cxd", ""]), (T.intersection(rx, T.regex(F.lit("a.*"))), ["a", "ab"], ["b", "ac"]), (T.difference(rx, fin("a", "b")), ["aa", "ab"], ["a", "b"])):
        p = pattern(s)
        assert all(re.fullmatch(p, w) for w in words) and not any(re.fullmatch(p, w) for w in others), p
    with pytest.raises(Exception, match="don't"):
        value(T.union(ints, rx))
    with pytest.raises(Exception, match="no integers"):
        value(T.union(ints, fin("x")))


def test_documents_of_sets(value):
    for s in (fin("a\"b", "c"), T.integers(iv((None, 3), (7, 7))), T.regex(F.lit('a"[\\w]')), T.regex(F.lit(None).cast("string")), T.empty(), T.universal()):
        doc = value(T.to_json(s))
        assert doc.startswith('{"type":"') and value(T.to_json(T.from_json(F.lit(doc)))) == doc


def test_patterns_from_languages():
    for p in ("a", "(ab|c)*d", "[^a-c]x?", "a{2,4}", "\\d+\\.", "(a|b)*abb"):
        again = regular.to_pattern(regular.parse(p))
        assert regular.equal(regular.parse(p), regular.parse(again)), again
    assert regular.to_pattern(regular.parse(None)) is None
