"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from graftline.llm.common import discard, read, store, words

#: Buckets of hashed n-grams; the fitted table has so many numbers, whatever the corpus.
BUCKETS = 32_768
#: At most so many trusted documents (least hash of doc_id first) and so many labelled as bad fit the target and the threshold; corpus counts have no bound.
TRUSTED, BAD = 20_000, 5_000
#: The threshold comes from trusted documents scored by ratios fitted without their fold.
FOLDS = 4
#: Smoothing: a bucket's prior count, spread as in the raw corpus.
PRIOR = 0.05
SYMBOLS = r"[^#*$%&|<>]+"


class Model(NamedTuple):
    """ratios: a stored table of one row with an array of one ratio for each bucket, or None where there was nothing to fit."""

    ratios: DataFrame | None
    buckets: int
    threshold: float


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def shifted(xs: Column, by: int) -> Column:
    return F.slice(xs, F.lit(by + 1), F.greatest(F.size(xs) - by, F.lit(0)))


def gram_ratios(h: Column, table: Column, buckets: int, start: Column | None = None) -> Column:
    """For each word the summed ratios of its own bucket and of its bigram's (the last word's is with the text's end); start: where the ratios begin in the table."""
    at = lambda x: F.pmod(x, F.lit(buckets)).cast("int") if start is None else F.pmod(x, F.lit(buckets)).cast("int") + start
    return F.zip_with(h, shifted(h, 1), lambda a, b: F.get(table, at(a)) + F.get(table, at(F.xxhash64(a, b))))


def gram_buckets(h: Column, buckets: int) -> Column:
    """Buckets of the same n-grams."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    return F.concat(one, F.zip_with(h, shifted(h, 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))


WIDTH = 5


def window_hashes(h: Column) -> Column:
    """64-bit hashes of the windows of WIDTH words."""
    return F.transform(shifted(h, WIDTH - 1), lambda x, i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH - 1)], x))


def covered_words(w: Column) -> Column:
    """Words in windows found twice or more: sort the windows by their whole hash, then place; keep those whose hash equals a neighbour's; add up the length of what they cover."""

    def repeats(s: Column) -> Column:
        same = F.zip_with(s, shifted(s, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        marked = lambda e: F.zip_with(s, F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda x, m: F.when(m, x["at"]))
        return let(same, marked)

    keyed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    places = F.array_sort(F.filter(let(keyed, repeats), lambda x: x.isNotNull()))
    steps = lambda p: F.zip_with(p, shifted(p, 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(WIDTH)), F.lit(WIDTH)).cast("long"))
    return F.aggregate(let(places, steps), F.lit(0).cast("long"), lambda s, x: s + x)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def with_hashes(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ws, the words, and h, their hashes, each worked out once: later projections refer to them more than once, so they aren't merged."""
    return docs.withColumn("ws", words(text)).withColumn("h", F.transform("ws", lambda w: F.xxhash64(w)))


def score(table: Column, buckets: int, start: Column | None = None) -> Column:
    """Mean log-likelihood ratio of a document's n-grams, over h, by a table of ratios; 0 without words."""
    each = gram_ratios(F.col("h"), table, buckets, start)
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.greatest(2 * F.size("h"), F.lit(1))


def _some(labels: DataFrame, good: int, most: int) -> DataFrame:
    ids = labels.filter(F.col("quality") == good).select("doc_id").dropna().distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _ratios(counts: DataFrame, totals: Row, buckets: int) -> DataFrame:
    """One row of two arrays: ratios, the smoothed log ratio of target to raw frequency of each bucket, and by_fold, the same without each fold's target counts, fold after fold."""
    n, spread = totals.raw + buckets, PRIOR * buckets
    target = sum((F.col(f"target{f}") for f in range(FOLDS)), F.lit(0))
    all_targets = sum(totals[f"target{f}"] for f in range(FOLDS))
    seen = (F.col("raw") + 1) / n
    ratio = lambda y, t: (F.log((y + spread * seen) / (t + spread)) - F.log(seen)).cast("float")
    each = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left").fillna(0)
    ratios = [ratio(target, all_targets), *[ratio(target - F.col(f"target{f}"), all_targets - totals[f"target{f}"]) for f in range(FOLDS)]]
    row = each.agg(F.sort_array(F.collect_list(F.struct("b", *[r.alias(f"r{i}") for i, r in enumerate(ratios)]))).alias("rows"))
    column = lambda i: F.transform("rows", lambda x: x[f"r{i}"])
    return row.select(column(0).alias("ratios"), F.concat(*[column(f + 1) for f in range(FOLDS)]).alias("by_fold"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, keep: float = 0.998) -> Model:
    """Target counts from trusted documents (labels.quality 1), raw counts from every document.

    The threshold lies a third of the way from the score that a share `keep` of the trusted documents reaches to the middle score
    of the documents labelled as bad, and never above the former; without bad ones, the former less 1. Without trusted ones it keeps all.
    Trusted documents are dealt into FOLDS by their text's hash, and each is scored by ratios without its own fold's counts: on the
    ratios it helped to fit, a document scores higher than a new one of the same kind, which is what the threshold must pass.
    The ratios are a stored table of one row; what comes to the driver is a row of totals and one of quantiles for each side."""
    good, bad = _some(labels, 1, TRUSTED).withColumn("side", F.lit(1)), _some(labels, 0, BAD).withColumn("side", F.lit(0))
    sides = F.broadcast(good.unionByName(bad).groupBy("doc_id").agg(F.min("side").alias("side")))  # at most TRUSTED + BAD rows
    found = docs.select("doc_id", "text").join(sides, "doc_id", "left").withColumn("fold", F.when(F.col("side").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))
    marked = with_hashes(found, F.col("text"))
    in_fold = [F.sum(F.expr(f"if(side = 1 and fold = {f}, 1, 0)")).alias(f"target{f}") for f in range(FOLDS)]
    counts = store(marked.select(F.explode(gram_buckets(F.col("h"), buckets)).alias("b"), "side", "fold").groupBy("b").agg(F.count("*").alias("raw"), *in_fold), "counts")
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["raw", *[f"target{f}" for f in range(FOLDS)]]]).first()
    if not sum(totals[1:]):
        return Model(None, buckets, -math.inf)
    ratios = store(_ratios(counts, totals, buckets), "ratios")
    discard(counts)
    tried = marked.filter("side is not null").withColumn("table", ratios.select("by_fold").scalar())
    seen = tried.select("side", score(F.col("table"), buckets, F.col("fold") * buckets).alias("s"))
    got = {x.side: (x.low, x.mid) for x in seen.groupBy("side").agg(F.expr(f"percentile_approx(s, {1 - keep}, 10000)").alias("low"), F.expr("percentile_approx(s, 0.5, 10000)").alias("mid")).collect()}
    low = got[1][0]
    return Model(ratios, buckets, min(low, low + (got[0][1] - low) / 3) if 0 in got else low - 1)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Adds to every row n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept.

    Columns of these names are replaced; others keep their place. Null and empty texts have no words and fail the base rules. Rows are judged one by one: repeated
    rows get the same verdict, no rows give no rows. The work is one pass without a shuffle; the table of ratios goes to the tasks as the value of a scalar subquery."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    text = F.coalesce(F.col(f"in_{names.index('text')}"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    out = with_hashes(inner, text).withColumn("w", window_hashes(F.col("h")))
    if model.ratios is not None:
        out = out.withColumn("table", model.ratios.select("ratios").scalar())
    out = out.select(
        *inner.columns,
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "ws")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("w")) == F.size("w"), F.lit(0).cast("long")).otherwise(covered_words(F.col("w"))).alias("n_repeat_words"),
        (F.lit(0.0) if model.ratios is None else score(F.col("table"), model.buckets)).alias("score"),
    )
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.threshold))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names) if c not in new], *new)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, those with a null or empty text among them; others, repeated rows too, stay as they are. The verdicts are written first: a filter pushed through the projections would work hashes out again for each word."""
    judged = judge(docs, fit(docs, read(spark, sf_dir, "labels")))
    return store(judged, "judged").filter("kept").select(*docs.columns)
