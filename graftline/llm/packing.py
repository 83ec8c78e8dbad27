"""Bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import gapless, read, store

CAPACITY, END = 1024, 2

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: a shorter first one, then full ones."""
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


_encoders: dict = {}


def encoder(tokenizer: str):
    """Texts -> ids as tokenizers gives them for a byte-level BPE file without special tokens added.

    Texts go to the faster tiktoken with that file's own vocabulary as ranks, which gives the same ids (a test compares them); texts
    that contain one of the file's special tokens go to tokenizers itself. One is kept in each Python worker."""
    if tokenizer not in _encoders:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        with open(tokenizer, encoding="utf-8") as f:
            said = json.load(f)
        special = {x["content"] for x in said.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in k): v for k, v in said["model"]["vocab"].items() if k not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(tokenizer)
        _encoders[tokenizer] = lambda text: slow.encode(text, add_special_tokens=False).ids if any(x in text for x in special) else fast.encode_ordinary(text)
    return _encoders[tokenizer]


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs: uid (one for each row of docs), key, piece, start, length, ids_crc32, and ids if asked for.

    A null text counts as empty and has the end token alone. Whole texts are encoded, batch by batch in the tasks."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(tokenizer)
        for b in batches:
            rows = []
            for uid, doc_id, body in zip(b["uid"], b["doc_id"].astype("Int64"), b["text"].fillna(""), strict=True):
                ids = np.asarray([*ids_of(body), end], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[s : s + n].tobytes()
                    rows.append((uid, doc_id, k, s, n, zlib.crc32(own), *[own] * keep_ids))
            out = pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
            yield out.astype({"doc_id": "Int64"})

    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInPandas(encode, PIECES + ", ids binary" * keep_ids)


class Run(NamedTuple):
    """Pieces of one length, by rank, go in order into sequences `first`, `first` + 1, ..., `each` of them in one, from `offset` on."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over all pieces, worked out on runs: equal lengths and equal gaps are held as counts.

    Pieces are swept from the longest down, gaps in order of size: the least gap that is large enough (the successor of the length)
    takes as many as fit, by rank, gaps are updated, and the sweep goes on; what no gap takes opens new sequences. This is what
    placing the pieces one by one would give. Its size depends on the capacity, not on the number of pieces."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    opened = 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        freed: list[tuple[int, int, int]] = []

        def fill(first: int, many: int, gap: int) -> None:
            nonlocal rank, left
            each = gap // length
            full, over = divmod(min(left, many * each), each)
            took = full * each + over
            runs.append(Run(length, rank, took, first, each, capacity - gap))
            freed.append((gap - each * length, first, full))
            if over:
                freed.append((gap - over * length, first + full, 1))
            rest = many - full - bool(over)
            if rest:
                freed.append((gap, first + full + bool(over), rest))
            rank, left = rank + took, left - took

        for gap in sorted(g for g in gaps if g >= length):
            if not left:
                break
            for first, many in gaps.pop(gap):
                if left:
                    fill(first, many, gap)
                else:
                    freed.append((gap, first, many))
        if left:
            each = capacity // length
            many = -(-left // each)
            fill(opened, many, capacity)
            opened += many
        for gap, first, many in freed:
            if gap and many:
                gaps.setdefault(gap, []).append((first, many))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to stored pieces with uid, piece and length.

    Distributed: the count of pieces by length (at most `capacity` rows go to the driver), their ranks within a length, and the
    application of the plan, a join with its runs. No rows give no rows."""
    spark = pieces.sparkSession
    runs = plan({x.length: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    runs_df = spark.createDataFrame([(r.length, r.rank, r.count, r.first, r.each, r.offset) for r in runs], "length long, r_rank long, r_count long, r_first long, r_each long, r_offset long")
    ranked = gapless(pieces.withColumn("__id", F.struct("uid", "piece")), "length", capacity, "__id", "__rank").drop("__id")
    # the plan has a number of runs that the capacity bounds
    ahead = F.col("__rank") - F.col("r_rank")
    out = ranked.join(F.broadcast(runs_df), "length").filter(ahead.between(0, F.col("r_count") - 1))
    out = out.withColumn("sequence_id", F.col("r_first") + F.floor(ahead / F.col("r_each")).cast("long")).withColumn("offset", F.col("r_offset") + ahead % F.col("r_each") * F.col("length"))
    return out.drop("__rank", "r_rank", "r_count", "r_first", "r_each", "r_offset")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Tokenizes and packs every row; repeated rows are packed as often as they come. keep_ids: with each piece's ids (little-endian unsigned 32-bit), so that sequences can be written."""
    return pack(store(tokenize(docs, tokenizer, key, text, capacity, end, keep_ids), "pieces"), capacity).drop("uid")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_vocabulary()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces."""
    return pack_documents(docs, public_vocabulary()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
