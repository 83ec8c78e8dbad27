"""Substring dedup by line and paragraph hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.llm.bit_filter import bit_filter, lets_through
from graftline.llm.common import discard, read, store
from graftline.llm.hashing import group_texts, mix, run_hashes, window_hashes, word_bounds, word_hashes

#: Unless told otherwise, a repeated line goes if it has so many words, and a run of repeated paragraphs if it has so many: shorter ones are phrases that unrelated documents share.
#: A passage that stands in the middle of a line loses the ends of its run to paragraphs that reach out of it, so this is less than the 50 words of a passage worth removing.
LINE_WORDS, RUN_WORDS = 25, 25
#: A paragraph begins at a word pair whose hash is the least of those within so many words on either side: paragraphs have more words than that, and the same passage is cut alike wherever it stands.
#: Where a word or a short cycle repeats, equal least hashes follow each other: the first of them begins a paragraph, and then each first one that is more than so many words after the last begin.
REACH = 4

UNITS = "uid long, doc_id long, kind int, seq int, start long, end long, n_words int, key long, check long"


def _begins(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words begin a paragraph; words of other documents don't count."""
    last = np.append(doc[1:] != doc[:-1], True)
    pair = window_hashes(np.append(h, np.uint64(0)), 2)
    pair[last] = mix(h[last])
    least = np.ones(len(pair), bool)
    for k in range(1, REACH + 1):
        other = doc[k:] != doc[:-k]
        least[k:] &= other | (pair[k:] <= pair[:-k])
        least[:-k] &= other | (pair[:-k] <= pair[k:])
    at = np.flatnonzero(least)
    if not len(at):
        return least
    tied = (np.diff(at) <= REACH) & (doc[at[1:]] == doc[at[:-1]])  # with the one before; their hashes are equal
    firsts = np.flatnonzero(np.append(True, ~tied))
    ends = np.append(firsts[1:], len(at))
    after = np.searchsorted(at, at + REACH + 1)
    begins = np.zeros(len(pair), bool)
    begins[at[firsts]] = True
    many = ends - firsts > 1
    for i, end in zip(firsts[many].tolist(), ends[many].tolist(), strict=True):
        while (i := int(after[i])) < end:
            begins[at[i]] = True
    return begins


def units(docs: DataFrame, bits=None, line_words: int = LINE_WORDS) -> DataFrame:
    """Lines (kind 0) and paragraphs (kind 1) of every text with digests of their words in lower case (A-Z), places in characters, end exclusive."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies = [(x or "").encode("utf-8", "surrogatepass").lower() for x in b["text"]]
            at = 0
            for group in group_texts(bodies):
                data = np.frombuffer(b"\n".join(group), np.uint8)
                row, at = np.arange(at, at + len(group)), at + len(group)
                starts, ends = word_bounds(data)
                if not len(starts):
                    continue
                h = word_hashes(data, starts, ends)
                offsets = np.cumsum([0, *[len(x) + 1 for x in group]])
                doc = np.searchsorted(offsets, starts, side="right") - 1
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                newline = np.concatenate([[0], np.cumsum(data == 10)])
                new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
                line = np.concatenate([[True], newline[starts[1:]] != newline[starts[:-1]]]) | new_doc
                for kind, first in ((0, line), (1, _begins(h, doc) | new_doc)):
                    lo = np.flatnonzero(first)
                    hi = np.append(lo[1:], len(h))
                    key, check = run_hashes(h, lo, hi, kind)
                    own = doc[lo]
                    seq = np.arange(len(lo)) - np.searchsorted(own, own)
                    base = chars[offsets[own]]
                    out = pd.DataFrame({"uid": b["uid"].to_numpy()[row[own]], "doc_id": b["doc_id"].astype("Int64").to_numpy()[row[own]], "kind": kind, "seq": seq, "start": chars[starts[lo]] - base, "end": chars[ends[hi - 1]] - base, "n_words": hi - lo, "key": key.view(np.int64), "check": check.view(np.int64)})
                    ok = out["n_words"].to_numpy() >= (max(line_words, 1) if kind == 0 else 1)
                    if bits is not None:
                        ok &= lets_through(bits.value, key)
                    yield out[ok].astype({"doc_id": "Int64"})

    return docs.select("uid", "doc_id", "text").mapInPandas(work, UNITS)


def removals(docs: DataFrame, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs (uid, doc_id, text), stored so that uid stays -> spans to remove: uid, doc_id, start, end (characters of the text as it was, end exclusive), n_words.

    Of each digest the earliest occurrence, by doc_id (null last), then uid, then place, stays; later ones are repeats. Repeated lines of line_words
    words go, and runs of neighbouring repeated paragraphs of run_words words (0: all of them); spans may overlap. Texts that are null, empty or without words
    have none. Digests are counted map-side first and only those that come twice are looked at again, so a digest that a third of all
    rows share makes no large group."""
    spark = docs.sparkSession
    twice = store(units(docs, None, line_words).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
    bits = spark.sparkContext.broadcast(bit_filter(twice))
    some = store(units(docs, bits, line_words), "units")
    bits.destroy()
    discard(twice)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "start")
    # stored, so that the join isn't tied to the aggregate's shuffle and a digest with very many places can be dealt over tasks
    first = store(some.groupBy("key", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    later = some.join(first, ["key", "check"]).filter((F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start")))
    later = store(later.select("uid", "doc_id", "kind", "seq", "start", "end", "n_words"), "later")
    lines = later.filter("kind = 0").select("uid", "doc_id", "start", "end", F.col("n_words").cast("long").alias("n_words"))
    island = F.col("seq") - F.row_number().over(Window.partitionBy("uid").orderBy("seq"))  # of one document's paragraphs
    runs = later.filter("kind = 1").withColumn("run", island).groupBy("uid", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"))
    return lines.unionByName(runs.filter(F.col("n_words") >= run_words).select("uid", "doc_id", "start", "end", "n_words"))


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one."""
    w = Window.partitionBy("uid").orderBy("start", "end")
    new = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start"), F.lit(True))
    return spans.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(w)).groupBy("uid", "part").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs -> uid, doc_id, start, end: what a deduplicated corpus leaves out, one row for each span. Repeated rows have their own uid and are repeats of the first.

    Units are lines, and paragraphs: as texts have no blank lines to go by, those are cut by their words (REACH), so that a passage within a line is cut alike wherever it stands.
    Columns besides key and text, of any name, aren't read; no rows give no rows."""
    own = store(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "docs")
    return merged(removals(own, line_words, run_words))


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    return find_repeats(read(spark, sf_dir, "documents")).select("doc_id", "start", "end")
