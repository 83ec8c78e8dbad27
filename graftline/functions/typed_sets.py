"""Sets of attribute values of any kind as one column: finite, of integers, regular languages, none, all.

A set is a struct (kind, items, ivals, pattern); what doesn't go with the kind is null. Kinds mix: finite values are tested against intervals and patterns, and become
them where a union needs it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graftline.functions import attribute_sets as A
from graftline.functions import regular

SET = "struct<kind: string, items: array<string>, ivals: array<struct<lo: bigint, hi: bigint>>, pattern: string>"
IVALS = "array<struct<lo: bigint, hi: bigint>>"
#: The names of kinds in JSON.
FINITE, INTEGERS, REGEX, EMPTY, ALL = "FiniteSet", "IntegerSet", "RegexSet", "EmptySet", "UniversalSet"


def _set(kind: str, items=None, ivals=None, pattern=None) -> Column:
    part = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    return F.struct(F.lit(kind).alias("kind"), part(items, "array<string>").alias("items"), part(ivals, IVALS).alias("ivals"), part(pattern, "string").alias("pattern"))


def finite(items: Column) -> Column:
    """Of an array of any values, taken as strings."""
    return _set(FINITE, F.array_sort(F.array_distinct(F.filter(items.cast("array<string>"), lambda x: x.isNotNull()))))


def integers(ivals: Column) -> Column:
    """Of an array of (lo, hi), null for no bound."""
    return _set(INTEGERS, ivals=A.int_normalise(ivals))


def regex(pattern: Column) -> Column:
    """Of a pattern; null is the empty language."""
    return _set(REGEX, pattern=pattern)


def empty() -> Column:
    return _set(EMPTY)


def universal() -> Column:
    return _set(ALL)


def _is(s: Column, kind: str) -> Column:
    return s["kind"] == kind


def _points(s: Column) -> Column:
    """A finite set of integers as intervals; null if a value is no integer."""
    whole = F.forall(s["items"], lambda x: x.rlike(r"^[+-]?[0-9]+$"))
    return F.when(whole, A.int_normalise(F.transform(s["items"], lambda x: F.struct(x.cast("bigint").alias("lo"), x.cast("bigint").alias("hi")))))


def _literal(x: Column) -> Column:
    """A pattern that matches one text alone."""
    return F.regexp_replace(x, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def as_pattern(s: Column) -> Column:
    """A pattern of the set's language; null is the empty one. Sets of integers have none: null too."""
    words = F.when(F.size(s["items"]) > 0, F.array_join(F.transform(s["items"], _literal), "|"))
    return F.when(_is(s, REGEX), s["pattern"]).when(_is(s, FINITE), words).when(_is(s, ALL), F.lit(r"(?:.|\n)*"))


def is_empty(s: Column) -> Column:
    none = regular.pattern_subset(s["pattern"], F.lit(None).cast("string"))
    return _is(s, EMPTY) | (_is(s, FINITE) & (F.size(s["items"]) == 0)) | (_is(s, INTEGERS) & (F.size(s["ivals"]) == 0)) | (_is(s, REGEX) & F.coalesce(none, F.lit(True)))


def is_universal(s: Column) -> Column:
    every = regular.pattern_subset(F.lit(r"(?:.|\n)*"), s["pattern"])
    return _is(s, ALL) | (_is(s, INTEGERS) & A.int_is_universal(s["ivals"])) | (_is(s, REGEX) & every)


def contains(s: Column, value: Column) -> Column:
    """Whether a value, as a string, is in the set."""
    number = value.try_cast("bigint")
    return (
        F.when(_is(s, FINITE), F.array_contains(s["items"], value))
        .when(_is(s, INTEGERS), F.coalesce(A.int_contains(s["ivals"], number), F.lit(False)))
        .when(_is(s, REGEX), regular.matches(value, s["pattern"]))
        .otherwise(_is(s, ALL))
    )


def _expanded(s: Column) -> Column:
    """The integers of bounded intervals, one by one; null if a bound lacks."""
    bounded = F.forall(s["ivals"], lambda x: x["lo"].isNotNull() & x["hi"].isNotNull())
    return F.when(bounded, F.flatten(F.transform(s["ivals"], lambda x: F.transform(F.sequence(x["lo"], x["hi"]), lambda v: v.cast("string")))))


def subset(a: Column, b: Column) -> Column:
    """Whether a's values are all b's."""
    each = lambda test: F.forall(a["items"], test)
    to_b = (
        F.when(_is(b, ALL), True)
        .when(_is(b, EMPTY), is_empty(a))
        .when(_is(a, EMPTY), True)
        .when(_is(a, FINITE) & _is(b, FINITE), F.size(F.array_except(a["items"], b["items"])) == 0)
        .when(_is(a, FINITE) & _is(b, REGEX), each(lambda x: regular.matches(x, b["pattern"])))
        .when(_is(a, FINITE) & _is(b, INTEGERS), each(lambda x: F.coalesce(A.int_contains(b["ivals"], x.try_cast("bigint")), F.lit(False))))
        .when(_is(a, INTEGERS) & _is(b, INTEGERS), A.int_subset(a["ivals"], b["ivals"]))
        .when(_is(a, INTEGERS) & _is(b, FINITE), F.coalesce(F.size(F.array_except(_expanded(a), b["items"])) == 0, F.lit(False)))
        .when(_is(a, INTEGERS) & _is(b, REGEX), F.coalesce(F.forall(_expanded(a), lambda x: regular.matches(x, b["pattern"])), F.lit(False)))
        .when(_is(a, REGEX) & (_is(b, REGEX) | _is(b, FINITE)), regular.pattern_subset(a["pattern"], as_pattern(b)))
        .when(_is(a, REGEX) & _is(b, INTEGERS), is_empty(a))
    )
    return F.coalesce(to_b, is_universal(b))


def equal(a: Column, b: Column) -> Column:
    return subset(a, b) & subset(b, a)


def union(a: Column, b: Column) -> Column:
    """Finite values become integers or patterns where the other side is; integers and patterns, or values that are no integers with integers, don't unite: an error."""
    wide = F.when(as_pattern(a).isNull(), as_pattern(b)).when(as_pattern(b).isNull(), as_pattern(a)).otherwise(regular.pattern_union(as_pattern(a), as_pattern(b)))
    ivals = lambda s: F.when(_is(s, INTEGERS), s["ivals"]).otherwise(_points(s))
    fits = ivals(a).isNotNull() & ivals(b).isNotNull()
    numbers = F.when(fits, _set(INTEGERS, ivals=A.int_union(ivals(a), ivals(b)))).otherwise(F.raise_error(F.lit("values that are no integers don't unite with integers")).cast(SET))
    return (
        F.when(_is(a, EMPTY), b)
        .when(_is(b, EMPTY), a)
        .when(_is(a, ALL) | _is(b, ALL), universal())
        .when(_is(a, FINITE) & _is(b, FINITE), _set(FINITE, A.finite_union(a["items"], b["items"])))
        .when((_is(a, INTEGERS) | _is(b, INTEGERS)) & ~(_is(a, REGEX) | _is(b, REGEX)), numbers)
        .when(~_is(a, INTEGERS) & ~_is(b, INTEGERS), _set(REGEX, pattern=wide))
        .otherwise(F.raise_error(F.lit("integers and patterns don't unite")).cast(SET))
    )


def _kept(a: Column, b: Column, wanted: bool) -> Column:
    """a's finite values that are in b, or that aren't."""
    return _set(FINITE, F.filter(a["items"], lambda x: contains(b, x) == F.lit(wanted)))


def intersection(a: Column, b: Column) -> Column:
    """A finite side keeps its values that are in the other."""
    return (
        F.when(_is(a, EMPTY) | _is(b, EMPTY), empty())
        .when(_is(a, ALL), b)
        .when(_is(b, ALL), a)
        .when(_is(a, FINITE), _kept(a, b, True))
        .when(_is(b, FINITE), _kept(b, a, True))
        .when(_is(a, INTEGERS) & _is(b, INTEGERS), _set(INTEGERS, ivals=A.int_intersection(a["ivals"], b["ivals"])))
        .when(_is(a, REGEX) & _is(b, REGEX), _set(REGEX, pattern=pattern_intersection(a["pattern"], b["pattern"])))
        .otherwise(F.raise_error(F.lit("integers and patterns don't meet")).cast(SET))
    )


def difference(a: Column, b: Column) -> Column:
    """a's values that aren't b's. All values but some have no form of their own unless b is of integers or a pattern: an error."""
    ivals = F.when(_is(b, INTEGERS), b["ivals"]).otherwise(F.coalesce(_points(_set(FINITE, F.filter(b["items"], lambda x: x.rlike(r"^[+-]?[0-9]+$")))), F.array().cast(IVALS)))
    return (
        F.when(_is(a, EMPTY) | _is(b, ALL), empty())
        .when(_is(b, EMPTY), a)
        .when(_is(a, FINITE), _kept(a, b, False))
        .when(_is(a, INTEGERS) & (_is(b, INTEGERS) | _is(b, FINITE)), _set(INTEGERS, ivals=A.int_difference(a["ivals"], ivals)))
        .when(_is(a, ALL) & _is(b, INTEGERS), _set(INTEGERS, ivals=A.int_complement(b["ivals"])))
        .when((_is(a, REGEX) | _is(a, ALL)) & (_is(b, REGEX) | _is(b, FINITE)), _set(REGEX, pattern=pattern_difference(as_pattern(a), as_pattern(b))))
        .otherwise(F.raise_error(F.lit("integers and patterns don't meet")).cast(SET))
    )


def to_json(s: Column) -> Column:
    """{"type", "data"}: an array, an array of [lo, hi], a pattern; null for no bound and for no data."""
    q = lambda data: F.concat(F.lit('{"type":"'), s["kind"], F.lit('","data":'), data, F.lit("}"))
    held = F.to_json(F.array(s["pattern"]))  # a text is quoted as the one item of an array is
    text = F.when(s["pattern"].isNull(), "null").otherwise(F.substr(held, F.lit(2), F.length(held) - 2))
    pairs = F.concat(F.lit("["), F.array_join(F.transform(s["ivals"], lambda x: F.concat(F.lit("["), F.coalesce(x["lo"].cast("string"), F.lit("null")), F.lit(","), F.coalesce(x["hi"].cast("string"), F.lit("null")), F.lit("]"))), ","), F.lit("]"))
    return F.when(_is(s, FINITE), q(F.to_json(s["items"]))).when(_is(s, INTEGERS), q(pairs)).when(_is(s, REGEX), q(text)).otherwise(q(F.lit("null")))


def from_json(doc: Column) -> Column:
    kind = F.get_json_object(doc, "$.type")
    whole = lambda t: F.from_json(doc, f"type string, data {t}")["data"]
    pairs = F.transform(whole("array<array<bigint>>"), lambda x: F.struct(F.get(x, F.lit(0)).alias("lo"), F.get(x, F.lit(1)).alias("hi")))
    return F.when(kind == FINITE, _set(FINITE, F.array_sort(F.array_distinct(whole("array<string>"))))).when(kind == INTEGERS, integers(pairs)).when(kind == REGEX, regex(whole("string"))).when(kind == EMPTY, empty()).when(kind == ALL, universal())


def text(s: Column) -> Column:
    """For output."""
    return F.when(_is(s, FINITE), F.concat(F.lit("{"), F.array_join(s["items"], ", "), F.lit("}"))).when(_is(s, INTEGERS), A.text(s["ivals"])).when(_is(s, REGEX), F.coalesce(s["pattern"], F.lit(""))).otherwise(s["kind"])


def _on_patterns(make):
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {x: regular.to_pattern(make(regular.parse(x[0]), regular.parse(x[1]))) for x in set(zip(a, b))}
        return pd.Series([known[x] for x in zip(a, b)], dtype="object")

    return run


def pattern_intersection(a: Column, b: Column) -> Column:
    """Column: a pattern of what both match; null for the empty language. A distinct pair is worked out once a batch."""
    return _on_patterns(regular.intersect)(a, b)


def pattern_difference(a: Column, b: Column) -> Column:
    return _on_patterns(regular.minus)(a, b)
