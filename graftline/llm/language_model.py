"""Scoring by a hidden Markov language model."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import read, store

STATES = 8
#: Words with at least a 1/KNOWN of all training tokens are carried to the tasks with their counts: KNOWN words at most, by counting.
KNOWN = 131_072
#: Words with at least a 1/OWN of them are symbols of their own; the others share CLASSES symbols by hash.
OWN, CLASSES = 16_384, 512
#: Rounds of Baum-Welch, each over all training documents, whole texts. Later rounds gain little (README).
ROUNDS = 5
#: Tokens whose probabilities a task holds at once; a longer text goes alone.
AT_ONCE = 1_000_000
END = b""  # the end token is no word, so nothing else has these bytes
#: Added to expected counts, in shares of the symbols' own frequency.
PRIOR = 2.0


class Words(NamedTuple):
    """known: word -> its place in symbols and counts; symbols from `own` on are classes. tokens, distinct: of the training tokens."""

    known: dict[bytes, int]
    symbols: np.ndarray
    counts: np.ndarray
    own: int
    tokens: int
    distinct: int


class Chain(NamedTuple):
    first: np.ndarray  # states of a text's first token
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words and the end. bytes.lower() and bytes.split() know ASCII letters and ASCII white space only."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n) over the training documents: counted in each task, then over all of them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for text in b["text"]:
                counts.update(tokens_of(text))
            if len(counts) > 400_000:
                yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
                counts = Counter()
        yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})

    return docs.filter("not held_out").select("text").mapInPandas(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Words:
    """The frequent words, of which there are KNOWN at most however large the corpus, and the totals."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = counts.filter((F.col("n") * KNOWN >= tokens) | (F.col("word") == F.lit(END))).orderBy(F.desc("n"), "word").collect()
    own = {w: i for i, w in enumerate(bytes(x.word) for x in rows if x.n * OWN >= tokens or bytes(x.word) == END)}
    known = {bytes(x.word): i for i, x in enumerate(rows)}
    symbols = [own[w] if w in own else len(own) + zlib.crc32(w) % CLASSES for w in known]
    return Words(known, np.array(symbols, np.int64), np.array([x.n for x in rows], np.int64), len(own), tokens, distinct)


def encode(docs: DataFrame, words) -> DataFrame:
    """uid, doc_id, held_out, symbols (unsigned 16-bit), and the words outside the frequent ones with their counts in the document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w: Words = words.value
        get, own, logs = w.known.get, w.own, np.log10(w.counts + 1.0)
        # of frequent words that share a class, the word's count is needed as well as the class
        shared_logs = np.where(w.symbols >= own, logs, 0.0)
        for b in batches:
            rows = []
            for uid, doc_id, held, text in zip(b["uid"], b["doc_id"], b["held_out"], b["text"], strict=True):
                toks = tokens_of(text)
                at = np.array([get(t, -1) for t in toks])
                symbols = w.symbols[at]
                rare: Counter[bytes] = Counter()
                if (new := np.flatnonzero(at < 0)).size:
                    others = [toks[i] for i in new]
                    rare = Counter(others)
                    code = {t: own + zlib.crc32(t) % CLASSES for t in rare}
                    symbols[new] = [code[t] for t in others]
                    at = at[at >= 0]
                rows.append((uid, doc_id, held, len(toks), len(at), float(logs[at].sum()), symbols.astype("<u2").tobytes(), float(shared_logs[at].sum()), list(rare.keys()), list(rare.values())))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ENCODED.split(", ")]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(work, ENCODED)


ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_frequent long, log_frequent double, symbols binary, log_shared double, rare array<binary>, rare_n array<long>"


def _groups(sequences: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of the sequences, longest first, in groups of about AT_ONCE tokens."""
    n = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-n, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    cuts = np.flatnonzero(np.diff(before // AT_ONCE)) + 1
    yield from (x for x in np.split(order, cuts) if len(x))


def _packed(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences, longest first: their symbols place by place, without padding; how many sequences reach each place; and where its symbols start."""
    n = np.array([len(s) for s in sequences])
    live = np.searchsorted(-n, -np.arange(n.max()), side="left")
    start = np.cumsum(live) - live
    flat = np.empty(n.sum(), np.int64)
    for i, s in enumerate(sequences):
        flat[start[: len(s)] + i] = s
    return flat, live, start


def expect(sequences: list[np.ndarray], chain: Chain, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Scaled forward and backward passes over whole sequences (longest first) -> expected counts: first states, moves, symbols by state; log-likelihood."""
    flat, live, start = _packed(sequences)
    k, bounds = len(chain.first), list(zip(start.tolist(), (start + live).tolist(), strict=True))
    emit = chain.emit[flat]
    alpha, scale = np.empty_like(emit), np.empty((len(flat), 1))
    a = chain.first
    for t, (lo, hi) in enumerate(bounds):
        a = (a[: hi - lo] @ chain.move if t else a) * emit[lo:hi]
        c = a.sum(1, keepdims=True)
        a /= c
        scale[lo:hi], alpha[lo:hi] = c, a
    moves, beta, back = np.zeros((k, k)), np.ones((live[0], k)), np.ascontiguousarray(chain.move.T)
    for t in range(len(bounds) - 1, 0, -1):
        lo, hi = bounds[t]
        ahead = emit[lo:hi] * beta[: hi - lo]
        ahead /= scale[lo:hi]
        alpha[lo:hi] *= beta[: hi - lo]  # each row turns from forward to posterior as the backward pass goes by
        before = bounds[t - 1][0]
        moves += alpha[before : before + hi - lo].T @ ahead
        beta[: hi - lo] = ahead @ back
    alpha[: live[0]] *= beta
    moves *= chain.move
    emitted = np.stack([np.bincount(flat, alpha[:, s], symbols) for s in range(k)], 1)
    return alpha[: live[0]].sum(0), moves, emitted, float(np.log(scale).sum())


def _expected(all_symbols: list[np.ndarray], chain: Chain, symbols: int) -> np.ndarray:
    """Expected counts as one table: a row for each symbol, then first states, and a row for each state's moves."""
    k = len(chain.first)
    out = np.zeros((symbols + 1 + k, k))
    for places in _groups(all_symbols):
        first, moves, emitted, _ = expect([all_symbols[i] for i in places], chain, symbols)
        out[:symbols] += emitted
        out[symbols] += first
        out[symbols + 1 :] += moves
    return out


def maximise(counts: np.ndarray, frequency: np.ndarray) -> Chain:
    """A chain from expected counts; emissions lean on the symbols' own frequencies, so none is 0."""
    k = counts.shape[1]
    symbols = len(frequency)
    emit = counts[:symbols] + PRIOR * symbols**0.5 * frequency[:, None]
    rest = counts[symbols:] + 0.1
    return Chain(rest[0] / rest[0].sum(), rest[1:] / rest[1:].sum(1, keepdims=True), emit / emit.sum(0))


def _start(symbols: int, frequency: np.ndarray, states: int) -> Chain:
    """Random emissions around the frequencies."""
    rng = np.random.default_rng(7)
    noise = rng.gamma(1.0, 1.0, (symbols, states)) + 0.2
    emit = noise * frequency[:, None]
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(0))


def train(encoded: DataFrame, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch: a start from seeded noise around the frequencies, then rounds in which expected counts of every token of every training
    document, by forward and backward passes over whole texts, are added up across partitions. A round's counts come to the driver as a row for each symbol: their number is bounded."""
    spark = encoded.sparkSession
    symbols = len(frequency)
    training = encoded.filter("not held_out")
    chain = _start(symbols, frequency, states)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(chain)

        def work(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros((symbols + 1 + states, states))
            for b in batches:
                total += _expected([np.frombuffer(x, "<u2").astype(np.int64) for x in b["symbols"]], sent.value, symbols)
            rows = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"row": rows, **{f"s{i}": total[rows, i] for i in range(states)}})

        schema = "row long, " + ", ".join(f"s{i} double" for i in range(states))
        got = training.select("symbols").mapInPandas(work, schema).groupBy("row").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]).collect()
        counts = np.zeros((symbols + 1 + states, states))
        for x in got:
            counts[x.row] = x[1:]
        chain = maximise(counts, frequency)
        sent.destroy()
    return chain


def likelihood(sequence: np.ndarray, chain: Chain) -> float:
    """Natural logarithm of the exact probability of one sequence by the scaled forward recursion, place by place."""
    a, total = chain.first * chain.emit[sequence[0]], 0.0
    for i, s in enumerate(sequence):
        if i:
            a = (a @ chain.move) * chain.emit[s]
        c = a.sum()
        total += math.log(c)
        a = a / c
    return total


def likelihoods(sequences: list[np.ndarray], chain: Chain) -> np.ndarray:
    """The same for many sequences at once, whole ones side by side."""
    out = np.zeros(len(sequences))
    for places in _groups(sequences):
        flat, live, start = _packed([sequences[i] for i in places])
        a, logs = chain.first, np.zeros(len(places))
        for t, (lo, n) in enumerate(zip(start.tolist(), live.tolist(), strict=True)):
            a = (a[:n] @ chain.move if t else a) * chain.emit[flat[lo : lo + n]]
            c = a.sum(1)
            logs[:n] += np.log(c)
            a /= c[:, None]
        out[places] = logs
    return out


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text, held_out) -> a row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model emits a symbol from a hidden state at each token: a frequent word itself, or the hash class of a rarer one, and then the
    word within its class by its smoothed count; every class has room for one unseen word. score is the log10 of the sum over all
    paths of states, with the probabilities of words in their classes. The end is a token of every text; null and empty texts have it alone.
    Rows with a null doc_id are scored and count as training rows where held_out is null. Repeated rows count as often as they come.
    Without training rows every word is unseen and scores are finite. Counts of rare words are joined by word; frequent ones, of which there
    is a bounded number, are carried to the tasks, so no joined word is in more than a 1/KNOWN of the training tokens."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    counts = store(count_words(docs), "counts")
    words = vocabulary(counts)
    if END not in words.known:
        words = Words({END: 0}, np.zeros(1, np.int64), np.zeros(1, np.int64), 1, words.tokens, words.distinct)
    sent = spark.sparkContext.broadcast(words)
    encoded = store(encode(docs.withColumn("uid", F.monotonically_increasing_id()), sent), "encoded")
    own, symbols = words.own, words.own + CLASSES
    rank = lambda w: F.pmod(F.crc32(w), F.lit(CLASSES))
    frequent = np.zeros(symbols)
    shared_n, shared_v = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(frequent, words.symbols, words.counts)
    in_class = words.symbols >= own
    np.add.at(shared_n, words.symbols[in_class] - own, words.counts[in_class])
    np.add.at(shared_v, words.symbols[in_class] - own, 1)
    rare_counts = counts.filter(F.col("n") * KNOWN < max(1, words.tokens)).filter(F.col("word") != F.lit(END))
    for x in rare_counts.groupBy(rank(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        shared_n[x.c] += x.n
        shared_v[x.c] += x.v
        frequent[own + x.c] += x.n
    frequency = (frequent + 1) / (frequent + 1).sum()
    chain = train(encoded, frequency, states, rounds)
    room = np.log10(shared_n + shared_v + 1)  # of each class
    model = spark.sparkContext.broadcast((chain, room))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, room = model.value
        for b in batches:
            seqs = [np.frombuffer(x, "<u2").astype(np.int64) for x in b["symbols"]]
            paths = likelihoods(seqs, chain) / math.log(10)
            left = np.array([room[s[s >= own] - own].sum() for s in seqs])
            yield b[["uid", "doc_id", "held_out", "n_tokens", "n_frequent", "log_frequent"]].assign(doc_id=b["doc_id"].astype("Int64"), part=paths - left + b["log_shared"])

    scored = encoded.drop("rare", "rare_n").mapInPandas(work, "uid long, doc_id long, held_out boolean, n_tokens long, n_frequent long, log_frequent double, part double")
    pairs = encoded.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("k"))
    log = F.log10(F.col("n") + 1) * F.col("k")
    found = pairs.join(rare_counts, "word").groupBy("uid").agg(F.sum("k").alias("k"), F.sum(log).alias("log_rare"))
    n = F.lit(float(words.tokens + words.distinct + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(found, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") * F.lit(int(words.tokens > 0)) + zero("k")).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("log_frequent") + zero("log_rare") - F.col("n_tokens") * F.log10(n)).alias("base_score"),
        (F.col("part") + zero("log_rare")).alias("score"),
    )


def op1_language_model(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return score(read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))
