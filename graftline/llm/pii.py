"""Personal data: patterns, and candidates chosen by boosted trees."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import read

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repetition and what may stand before a match keep the time in proportion to the text and find the same matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A pattern without which a text has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: High-recall generators of the same kinds; their spans may overlap the base's and each other.
CANDIDATES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{13,19}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{0,3}[\x20.-]?|[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Matches as structs (start, end, match): places in characters, from the lengths of matches and of what stands between them."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")

    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def walk(z: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["g"])
            end = start + F.length(x["m"])
            one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("match")))
            return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

        return F.aggregate(F.filter(z, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]

    return walk(zipped)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Whether the digits' check sum, every second one from the last doubled, is a multiple of 10."""
    ds = F.filter(F.split(F.reverse(d), ""), lambda x: x != "")
    value = lambda x, i: let(x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(ds, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return n.between(16, 19) & luhn(digits(match))
    return n.between(8, 15)


def base_spans(text: Column) -> Column:
    """The base's spans by kind, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    parts = []
    for kind in KINDS:
        at = F.filter(spans(text, BASE[kind], kind), lambda s: valid(kind, s["match"]))  # noqa: B023
        parts.append(F.when(text.rlike(NEEDS[kind]), at).otherwise(none))
    return F.concat(*parts)


class Feature(NamedTuple):
    name: str
    levels: int


#: Format and context of a candidate, each cut into a few levels: their product bounds the table that is fitted. What decides a base match, the check sum,
#: '+' and '@', is none of them, so that forms without it are scored as those with it.
FEATURES = (Feature("kind", 4), Feature("digits", 8), Feature("seps", 3), Feature("before", 4), Feature("after", 4), Feature("word", 3))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[A-Za-z0-9]$"), 2).otherwise(3)


def _plain(match: Column) -> Column:
    """A match with `[at]` and `[dot]` written as @ and a full stop."""
    return F.regexp_replace(F.regexp_replace(match, r"\x20?[\[(]\x20?at\x20?[\])]\x20?", "@"), r"\x20?[\[(]\x20?dot\x20?[\])]\x20?", ".")


def _around(text: Column, s: Column) -> tuple[Column, Column, Column]:
    """Levels of the characters before and after a candidate and of the word before it."""
    around = F.lower(F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(F.lit(24), s["start"])))
    before = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
    word = F.when(around.rlike(r"(?:e-?mail|phone|tel|call|card|visa|ip|address)\W*$"), 2).when(around.rlike(r"(?:version|id|isbn|order|number|no)\W*$"), 1).otherwise(0)
    return _side(before), _side(F.substring(text, s["end"] + 1, F.lit(1))), word


def evidence(text: Column, base: Column, s: Column) -> Column:
    """1, 0 or null (not known) for a candidate, by what its base form isn't needed for. Only others than 0 can be found.

    card: 13 to 19 digits, with a right check sum, beside no letter. ip: parts of up to 255. email: the base's, or else null if the last part of the host
    is letters. phone: the base's; 0 inside another kind's base span, beside a letter, or as digits without separators after no word for a phone; else null."""
    m = s["match"]
    before, after, word = _around(text, s)
    free = (before != 2) & (after != 2)
    confirmed = F.exists(base, lambda b: (b["kind"] == s["kind"]) & (b["start"] == s["start"]) & (b["end"] == s["end"]))
    other = F.exists(base, lambda b: (b["kind"] != s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    card = F.length(digits(m)).between(13, 19) & luhn(digits(m)) & free
    phone = valid("phone", m) & free & ~other & (m.rlike(r"[\x20().-]") | (word == 2))
    return (
        F.when(confirmed, 1)
        .when(s["kind"] == "card", card.cast("int"))
        .when(s["kind"] == "ip", valid("ip", m).cast("int"))
        .when(s["kind"] == "email", F.when(_plain(m).rlike(r"\.[A-Za-z]{2,}$"), F.lit(None).cast("int")).otherwise(0))
        .otherwise(F.when(phone, F.lit(None).cast("int")).otherwise(0))
    )


def features(text: Column, s: Column) -> list[Column]:
    m = _plain(s["match"])
    n, seps = F.length(digits(m)), F.length(F.regexp_replace(m, r"[^\x20().-]+", ""))
    return [
        sum((F.when(s["kind"] == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0)),
        F.when(n == 0, 0).when(n < 8, 1).when(n < 13, 2).when(n <= 16, n - 10).otherwise(7),
        F.least(seps, F.lit(2)),
        *_around(text, s),
    ]


class Tree(NamedTuple):
    """A tree of depth 2: feature and level of the root, then of its left and right child, and four leaves; left is `level or less`."""

    root: tuple[int, int]
    kids: tuple[tuple[int, int], tuple[int, int]]
    leaves: tuple[float, float, float, float]


class Model(NamedTuple):
    bias: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]  # a log-odds for each kind


Cell = tuple[tuple[int, ...], int, int, int, int]  # levels; positives and all for fitting, positives and all held out


def _walk(tree: Tree, x) -> int:
    side = int(x[tree.root[0]] > tree.root[1])
    f, level = tree.kids[side]
    return 2 * side + int(x[f] > level)


def boost(cells: list[Cell], rounds: int = 20, rate: float = 0.4) -> Model:
    """Gradient boosting of log loss on the table of levels, each cell weighing as many candidates as it has; Newton leaves.

    The threshold of a kind is the least log-odds down to which at least half of the held-out candidates of each score are confirmed; without any it's beyond reach."""
    n, p = sum(c[2] for c in cells), sum(c[1] for c in cells)
    bias = math.log((p + 1) / (n - p + 1))
    score = [bias] * len(cells)
    trees = []

    def split(own: list[int], g, h) -> tuple[float, tuple[int, int]]:
        best = (0.0, (0, FEATURES[0].levels))
        all_g, all_h = sum(g[i] for i in own), sum(h[i] for i in own)
        for f, feature in enumerate(FEATURES):
            by_g, by_h = [0.0] * feature.levels, [0.0] * feature.levels
            for i in own:
                by_g[cells[i][0][f]] += g[i]
                by_h[cells[i][0][f]] += h[i]
            left_g = left_h = 0.0
            for level in range(feature.levels - 1):
                left_g, left_h = left_g + by_g[level], left_h + by_h[level]
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, level))
        return best

    for _ in range(rounds if n else 0):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        g = [c[1] - c[2] * q for c, q in zip(cells, prob, strict=True)]
        h = [c[2] * q * (1 - q) for c, q in zip(cells, prob, strict=True)]
        every = list(range(len(cells)))
        _, root = split(every, g, h)
        sides = [[i for i in every if (cells[i][0][root[0]] > root[1]) == side] for side in (False, True)]
        kids = tuple(split(own, g, h)[1] for own in sides)
        tree = Tree(root, kids, (0.0,) * 4)
        sums = [[0.0, 0.0] for _ in range(4)]
        at = [_walk(tree, c[0]) for c in cells]
        for i in every:
            sums[at[i]][0] += g[i]
            sums[at[i]][1] += h[i]
        tree = tree._replace(leaves=tuple(round(rate * a / (b + 1), 6) for a, b in sums))
        score = [s + tree.leaves[k] for s, k in zip(score, at, strict=True)]
        trees.append(tree)
    thresholds = []
    for kind in range(len(KINDS)):
        by_score: dict[float, list[int]] = {}
        for s, c in zip(score, cells, strict=True):
            if c[0][0] == kind and c[4]:
                held = by_score.setdefault(round(s, 9), [0, 0])
                held[0] += c[3]
                held[1] += c[4]
        best = math.inf
        for s in sorted(by_score, reverse=True):
            if 2 * by_score[s][0] < by_score[s][1]:
                break
            best = s
        thresholds.append(best - 1e-6)
    return Model(bias, tuple(trees), tuple(thresholds))


def log_odds(x: list[Column], model: Model) -> Column:
    out = F.lit(model.bias)
    for t in model.trees:
        leaf = lambda side: F.when(x[t.kids[side][0]] > t.kids[side][1], F.lit(t.leaves[2 * side + 1])).otherwise(F.lit(t.leaves[2 * side]))  # noqa: B023, E731
        out = out + F.when(x[t.root[0]] > t.root[1], leaf(1)).otherwise(leaf(0))
    return out


def _proposed(docs: DataFrame) -> DataFrame:
    """Adds base and candidates to columns doc, text."""
    may = F.col("text").rlike("@|[0-9][^A-Za-z]{0,3}[0-9]|[\\[(] ?at ?[\\])]")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    found = F.concat(*[spans(F.col("text"), CANDIDATES[k], k) for k in KINDS])
    return docs.withColumn("base", base_spans(F.col("text"))).withColumn("candidates", F.when(may, found).otherwise(none))


def fit(docs: DataFrame) -> Model:
    """Boosted trees that tell candidates with evidence for them from those with evidence against them, by format and context, over every such candidate of every
    document. Candidates of which neither is known, as those in forms that the base can't match, are scored by the trees and not fitted.

    Counts of confirmed and other candidates by cell of levels are all that comes to the driver; the product of the levels bounds them. A fifth of the documents (by
    hash) is held out to set the thresholds."""
    rows = _proposed(docs.select(F.xxhash64("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))).select("doc", "text", "base", F.explode("candidates").alias("s"))
    yes = evidence(F.col("text"), F.col("base"), F.col("s"))
    names = [f.name for f in FEATURES]
    levels = rows.select(*[x.cast("int").alias(n) for x, n in zip(features(F.col("text"), F.col("s")), names, strict=True)], yes.alias("yes"), (F.pmod("doc", F.lit(5)) == 0).alias("out")).filter("yes is not null")
    when = lambda side, x: F.sum(F.when(F.col("out") == side, x).otherwise(0))
    got = levels.groupBy(*names).agg(when(False, F.col("yes")).alias("a"), when(False, F.lit(1)).alias("b"), when(True, F.col("yes")).alias("c"), when(True, F.lit(1)).alias("d")).collect()
    return boost(sorted((tuple(x[n] for n in names), x.a, x.b, x.c, x.d) for x in got))


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds to every row base and found: arrays of (kind, start, end, match), places in characters, ends exclusive; columns of these names are replaced.

    found holds the base's spans and the candidates that the trees choose, that have no evidence against them, and that overlap neither a base span nor a better candidate of their kind
    (a higher score, then the earlier, then the longer). By kind, then start. Null and empty texts have none. Rows are worked on one by one, without a shuffle."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    at = _proposed(inner)
    meet = lambda a, b: (a["kind"] == b["kind"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])
    scored = F.transform("candidates", lambda s: F.struct(log_odds(features(F.col("text"), s), model).alias("score"), s.alias("s")))
    reach = lambda k: sum((F.when(k == name, F.lit(t)).otherwise(0.0) for name, t in zip(KINDS, model.thresholds, strict=True) if math.isfinite(t)), F.when(k.isin([n for n, t in zip(KINDS, model.thresholds, strict=True) if math.isfinite(t)] or [""]), 0.0).otherwise(math.inf))
    chosen = F.filter(scored, lambda x: (x["score"] >= reach(x["s"]["kind"])) & ~F.exists("base", lambda b: meet(b, x["s"])) & (F.coalesce(evidence(F.col("text"), F.col("base"), x["s"]), F.lit(1)) == 1))
    ranked = F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct((-x["score"]).alias("a"), x["s"]["start"].alias("b"), (-x["s"]["end"]).alias("c"), x["s"].alias("s")))), lambda x: x["s"])
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    apart = F.aggregate(ranked, none, lambda acc, s: F.when(F.exists(acc, lambda b: meet(b, s)), acc).otherwise(F.concat(acc, F.array(s))))
    rank = lambda s: sum((F.when(s["kind"] == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    order = lambda spans_: F.transform(F.array_sort(F.transform(spans_, lambda s: F.struct(rank(s).alias("k"), s["start"].alias("b"), s.alias("s")))), lambda x: x["s"])
    extra = F.when(F.size("candidates") == 0, none).otherwise(apart)
    out = at.withColumn("extra", extra).withColumn("found", F.when(F.size("extra") == 0, F.col("base")).otherwise(order(F.concat("base", "extra"))))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names) if c not in ("base", "found")], "base", "found")


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
