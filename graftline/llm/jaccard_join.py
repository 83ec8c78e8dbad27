"""N-gram Jaccard self-join by universe-partition pigeonhole."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import discard, read, store
from graftline.llm.components import components
from graftline.llm.hashing import mix, shingle_set, shingle_sets


class Bands:
    """Size bands and their numbers of segments for a Jaccard threshold of num / den.

    Similar sets with sizes s <= t have t <= s * den / num and differ in at most (den - num) / (den + num) * (s + t) elements. A pair
    meets in the smaller set's band, under its number of segments: a set gives signatures for its own band and the one below."""

    def __init__(self, num: int, den: int) -> None:
        self.least, self.far = Fraction(num, den), Fraction(den - num, den + num)
        self.first: list[int] = [1]  # the smallest size of each band
        self.most: dict[int, int] = {}

    def differ(self, band: int) -> int:
        """The most differences of a similar pair whose smaller set is in the band."""
        if band in self.most:
            return self.most[band]
        s = self.from_size(band + 1) - 1
        t = math.floor(s / self.least)
        self.most[band] = math.floor(self.far * (s + t))
        return self.most[band]

    def from_size(self, band: int) -> int:
        while len(self.first) <= band:
            self.first.append(math.floor(self.first[-1] / self.least) + 1)
        return self.first[band]

    def of(self, size: int) -> int:
        while self.first[-1] <= size:
            self.from_size(len(self.first))
        return bisect.bisect_right(self.first, size) - 1

    def segments(self, band: int) -> int:
        return self.differ(band) + 1 + self.spare(band)

    def spare(self, band: int) -> int:
        """Segments beyond those that the most differences make necessary: a set gives so many of its segments, the costliest, no key."""
        return 3 + self.differ(band) // 4


def _values(own: np.ndarray) -> np.ndarray:
    return mix(own ^ np.uint64(0xD6E8FEB86659FD93))


def _salts(at: np.ndarray, band: np.ndarray) -> np.ndarray:
    """One for each segment (by number) of each band."""
    return mix(at.astype(np.uint64) + band.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(1))


def deletions(own: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Keys of a set with more than `spare` empty segments in a band: those of all segments with elements, their one-deletion neighbourhoods, and those of the empty ones where needed.

    Two such sets with z empty segments each meet in an equal segment with elements or in one that a single difference touches, unless their
    z sum to m + spare + 1 or more. Where that could be (few segments, or z over half of m + spare) they have keys for their empty segments too."""
    m, spare = bands.segments(band), bands.spare(band)
    with np.errstate(over="ignore"):
        at = (own % np.uint64(m)).astype(np.int64)
        value = _values(own)
        total = np.zeros(m, np.uint64)
        np.add.at(total, at, value)
        n = np.bincount(at, minlength=m)
        salt = _salts(np.arange(m), np.full(m, band))
        keys = mix(total + salt)
        near = mix(total[at] - value + salt[at])[n[at] > 1]
        empty = keys if m <= 24 or 2 * (n == 0).sum() > m + spare else keys[n > 0]
        return np.unique(np.concatenate([keys[n > 0], near, empty]))


def signatures_of(sets: list[np.ndarray], bands: Bands, level=None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which set) of the signatures of many sets (distinct hashes), in their own bands and those below: two similar sets share a key.

    A set's elements are dealt over m = d + 1 + spare segments, d being the most differences; a segment's key is the mixed sum of its elements. d differences
    touch at most d segments, so two similar sets are alike in spare + 1 segments at least. Cost-based allocation: level(keys) tells how many sets have a key, in powers
    of two, 0 for one alone; every set leaves out its `spare` costliest segments, empty ones first, then by level, then by key. That order is the
    same for all sets: of the segments two similar sets are alike in, `spare` or more come before the cheapest, so neither leaves out that one. Keys of
    level 0 are in no other set and left out as well. Without level the keys of all segments with elements are given, for counting. Sets with more than `spare` empty segments
    leave none out and add one-deletion neighbourhoods (deletions())."""
    sizes = np.array([len(x) for x in sets])
    keys, which = [], []
    some = np.flatnonzero(sizes)
    own_band = np.array([bands.of(n) for n in sizes[some]], np.int64)
    for down in (0, 1):
        ok = own_band >= down
        chosen, band = some[ok], own_band[ok] - down
        if not len(chosen):
            continue
        m = np.array([bands.segments(b) for b in band], np.int64)
        spare = np.array([bands.spare(b) for b in band], np.int64)
        own = np.concatenate([sets[i] for i in chosen])
        first = np.cumsum(m) - m
        at = (own % np.repeat(m, sizes[chosen]).astype(np.uint64)).astype(np.int64) + np.repeat(first, sizes[chosen])
        with np.errstate(over="ignore"):
            value = _values(own)
            all_m = int(m.sum())
            # exact sums modulo 2**64 from sums of halves
            low = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), all_m).astype(np.uint64)
            high = np.bincount(at, (value >> np.uint64(32)).astype(float), all_m).astype(np.uint64)
            full = np.bincount(at, minlength=all_m) > 0
            got = mix(low + (high << np.uint64(32)) + _salts(np.arange(all_m) - np.repeat(first, m), np.repeat(band, m)))
        of = np.repeat(np.arange(len(chosen)), m)
        many_empty = np.bincount(of[~full], minlength=len(chosen)) > spare
        if level is None:
            take = np.flatnonzero(full & ~many_empty[of])
        else:
            cost = np.where(full, level(got), 16)
            busy = ~many_empty & (np.bincount(of[cost > 0], minlength=len(chosen)) > spare)
            take = np.flatnonzero(busy[of])
            take = take[np.lexsort((got[take], -cost[take], of[take]))]
            place = np.arange(len(take)) - np.searchsorted(of[take], of[take])
            take = take[(place >= spare[of[take]]) & (cost[take] > 0)]
        keys.append(got[take])
        which.append(chosen[of[take]])
        for i in np.flatnonzero(many_empty):
            more = deletions(sets[chosen[i]], int(band[i]), bands)
            keys.append(more if level is None else more[level(more) > 0])
            which.append(np.full(len(keys[-1]), chosen[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(which)


#: Buckets of the table of levels that tasks carry (16 MB); with more keys a bucket has the highest of several, which costs rows and changes no result.
LEVEL_BUCKETS = 2**25


def levels(counted: DataFrame) -> np.ndarray:
    """A table of four bits for each bucket of keys: the highest level (1 + log2 of n, 15 at most) of the counted keys (key, n) in it."""
    bits = 64 - LEVEL_BUCKETS.bit_length() + 1
    each = counted.select(F.shiftrightunsigned("key", bits).alias("b"), F.least(F.floor(F.log2("n")) + 1, F.lit(15)).alias("level")).groupBy("b").agg(F.max("level").alias("level"))
    words = each.groupBy(F.shiftright("b", 4).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(level, cast(4 * (b & 15) as int)))").alias("bits")).toArrow()
    out = np.zeros(LEVEL_BUCKETS // 16, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def level_of(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    b = keys >> np.uint64(64 - LEVEL_BUCKETS.bit_length() + 1)
    return ((table[(b >> np.uint64(4)).astype(np.int64)] >> ((b & np.uint64(15)) << np.uint64(2))) & np.uint64(15)).astype(np.int64)


#: Counters of a set's sketch, eight to a long: how far two sets' counters differ is at most how far the sets do.
COUNTERS = 32
SETS = "uid long, doc_id long, n_shingles long, id long, c0 long, c1 long, c2 long, c3 long"


def _id_of(own: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(own ^ np.uint64(0x1234567)).sum(dtype=np.uint64).astype(np.int64))


def with_digests(docs: DataFrame, width: int) -> DataFrame:
    """For every row uid, doc_id, n_shingles, a 64-bit digest of the set, its id, and the set's sketch."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = np.empty((len(b), 6), np.int64)
            for k, own in enumerate(shingle_sets(b["text"], width)):
                counts = np.minimum(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=COUNTERS), 255).astype(np.uint8)
                rows[k] = [len(own), _id_of(own), *counts.view(np.int64)]
            out = pd.DataFrame(rows, columns=["n_shingles", "id", "c0", "c1", "c2", "c3"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            out.insert(0, "uid", b["uid"].to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return docs.select("uid", "doc_id", "text").mapInPandas(work, SETS)


#: Texts whose signatures are worked out at once.
AT_ONCE = 400


def _all_keys(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """key: of all sets, copies among them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                keys, _ = signatures_of(list(shingle_sets(b["text"].iloc[at : at + AT_ONCE], width)), bands)
                yield pd.DataFrame({"key": keys.view(np.int64)})

    return docs.select("text").mapInPandas(work, "key long")


def _signed(docs: DataFrame, width: int, bands: Bands, table) -> DataFrame:
    """(id, keys, text) of the rows that have signatures by the broadcast table of levels."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                texts = b["text"].iloc[at : at + AT_ONCE]
                sets = list(shingle_sets(texts, width))
                keys, which = signatures_of(sets, bands, lambda x: level_of(table.value, x))
                order = np.argsort(which, kind="stable")
                rows, first = np.unique(which[order], return_index=True)
                if len(rows):
                    own = pd.Series(np.split(keys[order].view(np.int64), first[1:]), dtype=object)
                    yield pd.DataFrame({"id": np.array([_id_of(sets[i]) for i in rows], np.int64), "keys": own, "text": texts.iloc[rows].to_numpy()})

    return docs.select("text").mapInPandas(work, "id long, keys array<long>, text string")


@contextmanager
def few_rows_a_batch(spark):
    """Rows that hold whole texts go to Python workers in small batches: a batch's texts must fit in memory however long they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, "500")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def _verified(pairs: DataFrame, signed: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Of stored pairs (a, b) of ids, those whose sets are similar, by exact intersection; a pair's two texts meet in one row."""
    num, den = bands.least.numerator, bands.least.denominator
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = store(signed.select("id", "text").join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple = (None, None)
        for p in batches:
            ok = []
            for a, x, t in zip(p["a"], p["x"], shingle_sets(p["y"], width), strict=True):
                if a != held[0]:
                    held = (a, shingle_set(x, width))
                s = held[1]
                both = np.intersect1d(s, t, assume_unique=True).size
                ok.append(den * both >= num * (len(s) + len(t) - both))
            yield p.loc[ok, ["a", "b"]]

    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    with few_rows_a_batch(pairs.sparkSession):
        out = store(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInPandas(work, "a long, b long"), "links")
    discard(texts)
    return out


def _classes(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, component), stored: what links (a, b) join, with the classes before them as stars, so that only new links take rounds."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if before is not None:
        edges = edges.unionByName(before.select(F.col("id").alias("u"), F.col("component").alias("v")))
    return store(components(edges).withColumnRenamed("node", "id"), "classes")


def _apart(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members with their component, of the keys whose members are still in several components."""
    placed = members.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    return placed.join(several, "key")


#: Rounds in which the members of a key that are in other components than one of them, drawn by hash, are compared with that one.
PIVOTS = 3


def _kept_keys(each: DataFrame) -> DataFrame:
    """each (id, key) -> key, lo: keys of several sets with the least of these; of keys that the same sets have one is enough, as it gives the same pairs.

    The same sets are told by the least, the greatest, the number and two sums of 31 bits of hashes, so no key's sets are gathered."""
    h = F.xxhash64("id")
    seen = each.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.sum(F.shiftrightunsigned(h, 33)).alias("s"), F.sum(h.bitwiseAND(F.lit(2**31 - 1))).alias("t"))
    return seen.filter("lo != hi").groupBy("lo", "hi", "n", "s", "t").agg(F.min("key").alias("key")).select("key", "lo")


#: Keys of a set by which pairs that share one of them are emitted once.
TOPS = 8


def _with_tops(rest: DataFrame) -> DataFrame:
    """Adds tops: the set's TOPS keys that most sets have, by number of sets, then key: an order that is the same for all sets."""
    counted = rest.join(rest.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "key")), False), 1, TOPS).alias("tops"))
    return rest.join(counted.select("id", F.transform("tops", lambda x: x["key"]).alias("tops")), "id")


def _once():
    """Of a pair that shares top keys only the first of these gives a row; a pair that shares other keys alone has one for each."""
    both = F.array_intersect(F.col("p.tops"), F.col("q.tops"))
    return F.coalesce(F.get(both, F.lit(0)) == F.col("p.key"), F.lit(True))


def _pairs(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _near_counters(bands: Bands):
    """Sizes and sketches of a similar pair: sizes within the threshold, counters within the most differences."""
    diff = F.lit(0)
    for c in ("c0", "c1", "c2", "c3"):
        for k in range(8):
            byte = lambda t: F.shiftright(F.col(f"{t}.{c}"), 8 * k).bitwiseAND(F.lit(255))  # noqa: B023, E731
            diff = diff + F.abs(byte("p") - byte("q"))
    num, den = bands.least.numerator, bands.least.denominator
    n, o = F.col("p.n_shingles"), F.col("q.n_shingles")
    return (den * F.least(n, o) >= num * F.greatest(n, o)) & ((den + num) * diff <= (den - num) * (n + o))


def _plausible(pairs: DataFrame, sizes: DataFrame, bands: Bands) -> DataFrame:
    """Pairs that sizes and sketches allow to be similar; no similar pair is dropped."""
    p, q = sizes.alias("p"), sizes.alias("q")
    return pairs.join(p, F.col("a") == F.col("p.id")).join(q, (F.col("b") == F.col("q.id")) & _near_counters(bands)).select("a", "b")


def classified(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5) -> DataFrame:
    """docs (uid, doc_id, text) -> uid, doc_id, n_shingles, component: a digest that is the same for the rows of one class; null for an empty set.

    Equal sets are one node from the start, by a 64-bit digest (as shingles are compared by 64-bit hashes), so copies cost nothing. Keys of all segments are counted,
    map-side first: no task gathers a key's documents. By these counts each set leaves out its costliest segments (signatures_of()), and a set whose segments few
    others have gives no key at all. Each set is compared with the least of each of its keys, then with PIVOTS others drawn
    by hash where a key's sets are still in several components; what then is in one key and in several components is compared pair by pair, if sizes and sketches
    allow similarity, which is tried inside the join and drops no similar pair. A large group of near copies so costs about as many pairs as it has documents."""
    spark = docs.sparkSession
    bands = Bands(num, den)
    sets = store(with_digests(docs, width), "sets")
    shared = store(_all_keys(docs, width, bands).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    table = spark.sparkContext.broadcast(levels(shared))
    signed = store(_signed(docs, width, bands, table), "signed")
    table.destroy()
    each = signed.select("id", F.explode("keys").alias("key"))
    members = store(each.join(_kept_keys(each), "key").distinct(), "members")
    discard(shared)
    sizes = store(sets.select("id", "n_shingles", "c0", "c1", "c2", "c3").join(members.select("id").distinct(), "id", "left_semi").distinct(), "sizes")
    tried = store(_plausible(members.filter("id != lo").select(*_pairs("id", "lo")).distinct(), sizes, bands), "pairs")
    classes = _classes(_verified(tried, signed, width, bands))
    apart = store(_apart(members.select("key", "id"), classes), "apart")
    for turn in range(PIVOTS):
        if apart.isEmpty():
            break
        drawn = F.xxhash64("id", F.lit(turn))
        pivots = apart.groupBy("key").agg(F.min_by("id", drawn).alias("pivot"), F.min_by("component", drawn).alias("own"))
        new = apart.join(pivots, "key").filter("component != own").select(*_pairs("id", "pivot")).distinct()
        new = store(_plausible(new.join(tried, ["a", "b"], "left_anti"), sizes, bands), "pairs")
        tried = tried.unionByName(new)
        links = _verified(new, signed, width, bands)
        if not links.isEmpty():  # components only grow together, so keys once settled stay so
            classes = _classes(links, classes)
            apart = store(_apart(apart.drop("component"), classes), "apart")
    rest = store(_with_tops(apart).join(sizes, "id"), "rest")
    p, q = rest.alias("p"), rest.alias("q")
    cross = (F.col("p.key") == F.col("q.key")) & (F.col("p.component") < F.col("q.component")) & _near_counters(bands) & _once()
    last = store(p.join(q, cross).select(*_pairs("p.id", "q.id")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not last.isEmpty():
        classes = _classes(_verified(last, signed, width, bands), classes)
    discard(signed, members, rest)
    placed = sets.select("uid", "doc_id", "n_shingles", "id").join(classes, "id", "left")
    return placed.select("uid", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).alias("component"))


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5) -> DataFrame:
    """docs (doc_id, text) -> one row for each row: doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their sets of `width`-word shingles is at least num / den; a component is what
    links reach, named by its least doc_id. A text without words, or null, has an empty set, links with nothing and is its own
    component. Rows with a null doc_id link like others but don't name a component (null if no other is in it); rows that repeat a
    doc_id are judged by their own texts. Other columns, of any name, aren't read; no rows give no rows."""
    found = classified(docs.select(F.lit(0).cast("long").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), num, den, width)
    linked = found.filter("component is not null")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = found.filter("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.join(names, "component").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row stays, that of the least doc_id (null last), of equal ones the first read; rows without words stay.

    Rows of equal doc_id and different texts are judged by their own texts. Columns may have any names; no rows give no rows."""
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("uid"))
    held = store(own, "rows")
    doc_id, text = (F.col(f"in_{names.index(c)}") for c in ("doc_id", "text"))
    found = classified(held.select("uid", doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    first = found.filter("component is not null").groupBy("component").agg(F.min(place).alias("first")).select("first.uid")
    kept = first.unionByName(found.filter("component is null").select("uid"))
    return held.join(kept, "uid", "left_semi").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])
