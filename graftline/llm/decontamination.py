"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import read, store

#: Edits allowed for each character of a test item.
RATE = 0.05
#: Unless told otherwise, items shorter than this, in normalised characters, are no evidence and match nothing.
SHORTEST = 20
#: Characters of test items, about, that one pass carries to the tasks; more items take more passes.
BLOCK_CHARS = 16_000_000

HITS = "array<struct<item_id: long, start: long, end: long, distance: int>>"


class Item(NamedTuple):
    item_id: int
    text: str
    budget: int
    pieces: tuple[tuple[int, str], ...]  # (place in the item, piece)


def normalise(text: str) -> tuple[str, list[int]]:
    """A-Z lower-cased, runs of white space as one space, none at the ends; and for each character its place in the text."""
    out, places = [], []
    gap = False
    for i, c in enumerate(text):
        if c in " \t\n\x0b\x0c\r":
            gap = bool(out)
            continue
        if gap:
            out.append(" ")
            places.append(i - 1)
            gap = False
        out.append(c.lower() if "A" <= c <= "Z" else c)
        places.append(i)
    return "".join(out), places


_LOWER = {i: i + 32 for i in range(65, 91)}


def normalised(text: str) -> str:
    return " ".join(x for x in text.translate(_LOWER).translate(_SPACES).split(" ") if x)


_SPACES = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def item(item_id: int, text: str | None, rate: float = RATE, shortest: int = SHORTEST) -> Item | None:
    body = normalised(text or "")
    if len(body) < max(shortest, 1):
        return None
    budget = int(rate * len(body))
    cuts = [len(body) * i // (budget + 1) for i in range(budget + 2)]
    return Item(item_id, body, budget, tuple((a, body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the best approximate occurrence of pattern in text, the first such end: Myers' bit-parallel algorithm on one whole-number word of any length."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = full, 0, len(pattern)
    best, end = score, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at
        up, down = (up << 1) & full, (down << 1) & full  # row 0 stays 0: an occurrence may begin anywhere
        plus, minus = down | (full & ~(zero | up)), up & zero
    return best, end


class Matcher:
    """Finds items in texts: exact pieces by an Aho-Corasick automaton, then the edit distance around each hit."""

    def __init__(self, items: list[Item]) -> None:
        import ahocorasick

        self.items = items
        at = defaultdict(list)
        for i, x in enumerate(items):
            for place, piece in x.pieces:
                at[piece].append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) in places of the text's characters, one for each item that is within its budget anywhere, its best."""
        if not text or not self.items:
            return []
        body = normalised(text)
        windows = defaultdict(list)
        for last, (n, where) in self.automaton.iter(body):
            for i, place in where:
                x = self.items[i]
                begin = last + 1 - n - place
                windows[i].append((begin - x.budget, begin + len(x.text) + x.budget))
        found = []
        for i, spans in windows.items():
            x, best = self.items[i], None
            spans.sort()
            joined = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            for a, b in joined:
                a = max(0, a)
                part = body[a:b]
                distance, end = best_match(x.text, part)
                if distance <= x.budget and (best is None or distance < best[0]):
                    # the same search backwards from the end finds where it begins
                    back = best_match(x.text[::-1], part[:end][::-1])[1] if end else 0
                    best = (distance, a + end - back, a + end)
            if best:
                found.append((x.item_id, best[1], best[2], best[0]))
        if not found:
            return []
        _, places = normalise(text)
        return sorted((i, places[a], places[b - 1] + 1, d) for i, a, b, d in found)


def hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, shortest: int = SHORTEST) -> DataFrame:
    """Adds to every row `name`, an array of (item_id, start, end, distance): the items of which an occurrence is within the budget.

    An item of n normalised characters (A-Z lower-cased, white space as one space) may differ by floor(rate * n) edits; it is cut into one
    piece more, and as no piece can hide from all edits, one of them stands in the text exactly. Items without characters or with fewer than `shortest` (0: none are too short),
    with a null text or a null item_id match nothing, nor do null and empty texts. Items equal in id and text are one; those equal in id alone are
    looked for each, and may give two entries. Repeated rows get the same entries; no rows give no rows. A column called `name` is replaced, others may have any name.

    Items are taken in blocks of bounded size, one after the other, each against all rows in one pass over them; only one block is on the driver and in the tasks at a time."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_chars) or 1
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    body = F.col(f"in_{names.index(text)}")
    if blocks == 1:
        out = own.withColumn("found", _finder(_block(benchmark, 0, 1, rate, shortest))(body))
    else:
        held = store(own.withColumn("uid", F.monotonically_increasing_id()), "rows")
        parts = []
        for block in range(blocks):
            items = _block(benchmark, block, blocks, rate, shortest)
            parts.append(store(held.select("uid", _finder(items)(body).alias("found")).filter(F.size("found") > 0), "hits"))
            items.destroy()
        found = reduce(DataFrame.unionByName, parts).groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
        out = held.join(found, "uid", "left").withColumn("found", F.coalesce("found", F.array().cast(HITS)))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names) if c != name], F.col("found").alias(name))


def _block(benchmark: DataFrame, block: int, blocks: int, rate: float, shortest: int):
    """A block's items, broadcast."""
    chosen = benchmark.filter(F.col("item_id").isNotNull()).filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    rows = chosen.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().collect()
    return benchmark.sparkSession.sparkContext.broadcast([y for x in rows if (y := item(x.item_id, x.text, rate, shortest))])


def _finder(items):
    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items.value)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "start": a, "end": b, "distance": d} for i, a, b, d in matcher.find(t)] for t in texts])

    return find


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("x")).select("doc_id", "x.item_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), "x.distance")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which a test item stands go; null and empty texts and repeated rows stay."""
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    found = hits(own, read(spark, sf_dir, "benchmark"), "found", f"in_{names.index('text')}")
    return found.filter(F.size("found") == 0).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])
