"""Sets of attribute values: finite sets as sorted arrays, integer sets as sorted arrays of (lo, hi), null for no bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = -(2**62), 2**62


def finite_union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def finite_intersection(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def finite_difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def finite_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _closed(x: Column) -> Column:
    return F.struct(F.coalesce(x["lo"], F.lit(LOW)).alias("lo"), F.coalesce(x["hi"], F.lit(HIGH)).alias("hi"))


def _opened(x: Column) -> Column:
    return F.struct(F.when(x["lo"] > LOW, x["lo"]).alias("lo"), F.when(x["hi"] < HIGH, x["hi"]).alias("hi"))


def int_normalise(ivals: Column) -> Column:
    """Sorted disjoint intervals; neighbours such as (1, 2) and (3, 4) become one, empty ones go."""
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (x["lo"] <= F.get(acc, F.size(acc) - 1)["hi"] + 1), joined).otherwise(F.concat(acc, F.array(x)))

    step_ = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x))
    clean = F.array_sort(F.filter(F.transform(ivals, _closed), lambda x: x["lo"] <= x["hi"]))
    return F.transform(F.aggregate(clean, none, step_), _opened)


def normalised_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, lo, hi in rows, one interval each -> the same as sorted disjoint intervals, still one a row: for groups too large for an array. null is no bound."""
    closed = rows.select(*keys, F.coalesce("lo", F.lit(LOW)).alias("lo"), F.coalesce("hi", F.lit(HIGH)).alias("hi")).filter("lo <= hi")
    by = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = closed.withColumn("before", before).withColumn("part", F.sum(F.when(F.col("before").isNull() | (F.col("lo") > F.col("before") + 1), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*keys, F.when(F.col("lo") > LOW, F.col("lo")).alias("lo"), F.when(F.col("hi") < HIGH, F.col("hi")).alias("hi"))


def int_subset(a: Column, b: Column) -> Column:
    """Each interval of a inside one of b; both normalised."""
    one, two = F.transform(a, _closed), F.transform(b, _closed)
    return F.forall(one, lambda x: F.exists(two, lambda y: (x["lo"] >= y["lo"]) & (x["hi"] <= y["hi"])))


def int_is_empty(a: Column) -> Column:
    return F.size(a) == 0


def int_is_universal(a: Column) -> Column:
    return (F.size(a) == 1) & F.get(a, F.lit(0))["lo"].isNull() & F.get(a, F.lit(0))["hi"].isNull()


def int_union(a: Column, b: Column) -> Column:
    return int_normalise(F.concat(a, b))


def int_intersection(a: Column, b: Column) -> Column:
    cut = lambda x: F.transform(F.transform(b, _closed), lambda y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi")))
    return int_normalise(F.flatten(F.transform(F.transform(a, _closed), cut)))


def int_complement(a: Column) -> Column:
    """All other integers."""
    own = F.transform(int_normalise(a), _closed)
    his = F.concat(F.transform(own, lambda x: x["lo"] - 1), F.array(F.lit(HIGH)))
    los = F.concat(F.array(F.lit(LOW)), F.transform(own, lambda x: x["hi"] + 1))
    return int_normalise(F.zip_with(los, his, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))))


def int_difference(a: Column, b: Column) -> Column:
    return int_intersection(a, int_complement(b))


def int_contains(a: Column, value: Column) -> Column:
    return F.exists(F.transform(a, _closed), lambda x: value.between(x["lo"], x["hi"]))


def text(ivals: Column) -> Column:
    """Intervals as text, for output."""
    return F.array_join(F.transform(ivals, lambda x: F.concat(F.coalesce(x["lo"].cast("string"), F.lit("-inf")), F.lit(".."), F.coalesce(x["hi"].cast("string"), F.lit("inf")))), ",")
