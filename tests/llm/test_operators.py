"""Operators against brute force, with nulls, empty texts, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(60)]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def changed(t, k):
    w = t.split(" ")
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(VOCAB)
    return " ".join(w)


def corpus():
    base = [text(R.randint(3, 90)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for _ in range(45):
        rows.append((len(rows), changed(R.choice(base), R.randint(0, 4))))
    return [*rows, (len(rows), ""), (len(rows) + 1, None), (None, base[0]), rows[3], (len(rows) + 2, "One\nline " + "x" * 500)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in corpus()], "doc_id long, text string, score string")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_join(docs):
    from graftline.llm.jaccard_join import near_duplicates

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()) == want
    assert near_duplicates(docs.limit(0)).count() == 0


def test_signatures_meet():
    import numpy as np

    from graftline.llm.hashing import mix
    from graftline.llm.jaccard_join import Bands, signatures_of

    bands, rng = Bands(4, 5), np.random.default_rng(1)
    # any levels give similar sets a common key, as long as shared keys have one above 0
    costs = [lambda k: np.ones(len(k), np.int64), lambda k: (mix(k) % np.uint64(9) + np.uint64(1)).astype(np.int64), lambda k: np.where(mix(k) % np.uint64(3) == 0, 15, 1)]
    for n in [*range(1, 40), 60, 100, 250, 700]:
        for turn in range(30):
            s = rng.integers(0, 2**63, n, dtype=np.uint64)
            t = s[: n - int(rng.integers(0, n // 8 + 1))]
            t = np.concatenate([t, rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(s, t))
            if 5 * both >= 4 * (len(s) + len(t) - both):
                counted = set(signatures_of([np.sort(s)], bands)[0].tolist()) & set(signatures_of([np.sort(t)], bands)[0].tolist())
                shared = lambda k: np.where(np.isin(k, np.array(sorted(counted), np.uint64)), costs[turn % 3](k), 0)  # noqa: B023, E731
                keys, which = signatures_of([np.sort(s), np.sort(t)], bands, shared)
                assert set(keys[which == 0].tolist()) & set(keys[which == 1].tolist()), (len(s), len(t))


def test_levels(spark):
    import numpy as np

    from graftline.llm.jaccard_join import level_of, levels

    rng = np.random.default_rng(4)
    keys, n = rng.integers(-(2**63), 2**63, 500), rng.integers(2, 40_000, 500)
    table = levels(spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, n, strict=True)], "key long, n long"))
    assert (level_of(table, keys.view(np.uint64)) >= np.minimum(np.floor(np.log2(n)) + 1, 15)).all()
    assert (level_of(table, rng.integers(0, 2**63, 500, dtype=np.uint64)) > 0).sum() < 5


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_line_pairs(spark):
    from graftline.llm.line_dedup import near_pairs

    def edit(s, k):
        s = list(s)
        for _ in range(k):
            i = R.randrange(len(s))
            s[i : i + R.randint(0, 1)] = R.choice(["", "z", "q"])
        return "".join(s)

    base = ["".join(R.choice("abcdefg hé") for _ in range(R.randint(26, 40))).strip().ljust(26, "q") for _ in range(15)]
    lines = [edit(R.choice(base), R.randint(0, 4)) for _ in range(90)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("k1", F.xxhash64("line"))
    name = {r.k1: r.line for r in df.collect()}
    own = sorted(set(lines))
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if lev(a, b) <= 2}
    assert {tuple(sorted((name[r.a], name[r.b]))) for r in near_pairs(df, 2).collect()} == want


def test_line_dedup(spark):
    from graftline.llm.line_dedup import dedup_lines

    line, near = "a line of more than twenty-four characters", "a line of more than twenty-five characters"[:-1]
    rows = [(1, f"{line}\nshort"), (2, f"short\n{line}\nand an entirely different second line"), (3, line.replace("line", "lime")), (4, None), (5, ""), (None, near + " but different")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (f"{line}\nshort", 2, 0) and got[2] == ("short\nand an entirely different second line", 3, 1)
    assert got[3] == ("", 1, 1) and got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[None][2] == 0


def test_short_lines(spark, tmp_path):
    from graftline.llm import line_dedup

    rights, other = "All rights reserved.", "a first line that no other is like"
    rows = [(1, f"{rights}\n\n}}\n{other}\nxy"), (2, f"{rights}\n}}\n\n{other[::-1]}\nzw"), (3, "All rights reserved!\n12345\n\n"), (4, " }\n12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: rows[0][1], 2: f"\n{other[::-1]}\nzw", 3: "12345\n\n", 4: "12345678"}
    assert {r.doc_id: r.text for r in line_dedup.op6_lines(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in line_dedup.stage(spark, df, "").collect()} == want
    # every pair of short lines by brute force
    own = sorted({"".join(R.choice("abc") for _ in range(R.randint(3, 8))) for _ in range(60)})
    name = spark.createDataFrame([(x,) for x in own], "line string").withColumn("k1", F.xxhash64("line"))
    by = {r.k1: r.line for r in name.collect()}
    pairs = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if lev(a, b) <= 2}
    assert {tuple(sorted((by[r.a], by[r.b]))) for r in line_dedup.near_pairs(name, 2).collect()} == pairs


def test_language_model(docs):
    import numpy as np

    from graftline.llm import language_model as lm

    out = lm.score(docs.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out")), rounds=1).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = Counter(w for d, t in rows if d is None or d % 7 != 2 for w in lm.tokens_of(t))
    n, v = sum(train.values()), len(train)
    want = Counter((d, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in lm.tokens_of(t)), 6)) for d, t in rows)
    assert Counter((r.doc_id, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 for r in out)
    rng = np.random.default_rng(2)
    chain = lm.maximise(rng.random((20 + 1 + 3, 3)), np.full(20, 0.05))
    seqs = [rng.integers(0, 20, k) for k in (1, 5, 300, 2500)]
    assert np.allclose(lm.likelihoods(seqs, chain), [lm.likelihood(s, chain) for s in seqs])


def test_training_reads_all_in_every_round(spark):
    import numpy as np

    from graftline.llm import language_model as lm

    rng = np.random.default_rng(5)
    frequency = np.full(12, 1 / 12)
    seqs = [rng.integers(0, 6, 2_100) if i % 700 else np.concatenate([rng.integers(0, 6, 2_100), np.arange(2_000) % 2 + 10]) for i in range(40)] + [np.arange(30) % 3 + 6 + i % 2 for i in range(2_400)]
    rows = [(i, i, False, x.astype("<u2").tobytes()) for i, x in enumerate(seqs)] + [(-1, -1, True, np.full(500, 11, "<u2").tobytes())]
    chain = lm._start(12, frequency, 3)
    for _ in range(4):
        chain = lm.maximise(lm._expected(seqs, chain, 12), frequency)
    got = lm.train(spark.createDataFrame(rows, "doc_id long, uid long, held_out boolean, symbols binary"), frequency, 3, 4)
    assert all(np.allclose(a, b) for a, b in zip(got, chain, strict=True))


def test_expected_counts_by_enumeration():
    import itertools

    import numpy as np

    from graftline.llm import language_model as lm

    rng = np.random.default_rng(3)
    chain = lm.maximise(rng.random((4 + 1 + 2, 2)), np.full(4, 0.25))
    s = np.array([0, 3, 1, 1])
    total, emitted = 0.0, np.zeros((4, 2))
    for path in itertools.product(range(2), repeat=4):
        p = chain.first[path[0]] * chain.emit[s[0], path[0]]
        for i in range(1, 4):
            p *= chain.move[path[i - 1], path[i]] * chain.emit[s[i], path[i]]
        total += p
        for i, z in enumerate(path):
            emitted[s[i], z] += p
    _, moves, got, log = lm.expect([s], chain, 4)
    assert np.allclose(got, emitted / total) and math.isclose(log, math.log(total)) and math.isclose(moves.sum(), 3)


def test_sharding(docs):
    from graftline.llm.sharding import fleet, grow, shard_documents

    now = fleet(2, 2, 2)
    out = shard_documents(docs, now, grow(now)).collect()
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    texts = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in ((r.doc_id, r.text) for r in docs.collect()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts


def test_quality(docs, spark):
    from graftline.llm import quality

    extra = spark.createDataFrame([(900, "a b c d e f a b c d e x\n \nq\nq", "")], docs.schema)
    out = quality.judge(docs.unionByName(extra), quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")))
    for r in out.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_packing(docs):
    from tokenizers import Tokenizer

    from graftline.llm.packing import pack_documents, plan, public_vocabulary

    out = pack_documents(docs, public_vocabulary(), capacity=64).collect()
    t = Tokenizer.from_file(public_vocabulary())
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sum(r.length for r in out) == sum(n * k for (_, n), k in want.items())
    for s in {r.sequence_id for r in out}:
        end = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    lengths = [R.randint(1, 64) for _ in range(400)]
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, x in enumerate(bins) if x >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(64 - n)
    runs = plan(Counter(lengths), 64)
    assert max(r.first + -(-r.count // r.each) for r in runs) == len(bins)


def test_urls(spark):
    from graftline.llm.url_filter import judge

    link = '<html><link rel="canonical" href="http://x.com/de/1"></html>'
    rows = [(1, "http://A.b.org/x?q", ""), (2, "http://example.org/es/1", ""), (3, "http://q.net/a", link), (4, None, None), (5, "nonsense", ""), (6, "https://fr.com/fr/", ""), (7, "http://z.net/", '<meta http-equiv="refresh" content="0; url=http://q.net/a#x">')]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("a.b.org", "/x", "org/", "allow"), 2: ("example.org", "/es/1", "example.org/es/", "block"), 3: ("q.net", "/a", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("fr.com", "/fr/", "com/fr/", "allow"), 7: ("z.net", "/", None, "block")}


def test_decontamination(spark):
    from graftline.llm.decontamination import best_match, hits

    passage = text(30)
    docs = spark.createDataFrame([(1, text(40) + " " + passage.upper() + "\n" + text(9)), (2, passage[:40] + "x" + passage[41:]), (3, text(60)), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (8, None), (9, "tiny")], "item_id long, text string")
    got = {r.doc_id: [(x.item_id, x.distance) for x in r.hits] for r in hits(docs, bench).collect()}
    assert got == {1: [(7, 0)], 2: [(7, 1)], 3: [], 4: [], 5: []}
    for _ in range(200):
        a, b = "".join(R.choice("ab") for _ in range(R.randint(1, 8))), "".join(R.choice("ab") for _ in range(R.randint(1, 12)))
        assert best_match(a, b)[0] == min(lev(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def test_repeats(spark):
    from graftline.llm.repeats import find_repeats

    passage = " ".join(f"w{R.randrange(10**6)}" for _ in range(70))
    rows = [(2, text(30) + " " + passage + " " + text(20)), (1, text(10) + " " + passage), (3, text(50)), (4, None), (5, "")]
    got = find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {2}
    body = rows[0][1]
    assert all(body[r.start : r.end] in passage for r in got) and sum(r.end - r.start for r in got) > len(passage) / 2


def test_repeats_in_cycles(spark):
    from graftline.llm.repeats import find_repeats

    cycles = ["la", "tick tock", "one two three", "a b c d", "na na na hey"]
    parts = {i: ((c + " ") * 130).split()[:120] for i, c in enumerate(cycles)}
    around = lambda: [f"u{R.randrange(10**9)}" for _ in range(R.randint(11, 19))]
    rows = []
    for i, run in parts.items():
        before, after = around(), around()
        rows += [(10 + i, " ".join(before + run + after), len(before), len(after)), (20 + i, " ".join((x := around()) + run[: 90 + i] + (y := around())), len(x), len(y))]
    got = find_repeats(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    for doc, body, n_before, n_after in rows:
        held = [w for r in got if r.doc_id == doc for w in body[r.start : r.end].split()]
        own = body.split()
        assert set(held) <= set(own[n_before : len(own) - n_after])  # no word from around the run
        if doc >= 20:
            assert len(held) >= len(own) - n_before - n_after - 24


def test_pii(spark):
    from graftline.llm import pii

    rows = [(1, "é mail a.b@c.de, +1 (743) 555-3824 or 10.0.0.255 to 4111 1111 1111 1111 x"), (2, "1.2.3.999 and 4111111111111112"), (3, None), (4, ""), (5, "9" * 30000 + "a" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.match) for s in r.base] for r in pii.find(df, pii.fit(df)).collect()}
    assert got == {1: [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")], 2: [], 3: [], 4: [], 5: []}


def test_pii_beyond_the_base(spark):
    from graftline.llm import pii

    def card(n):
        body = "3" + "".join(R.choice("0123456789") for _ in range(n - 2))
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    word = lambda: "".join(R.choice("bcdfg") for _ in range(6))
    local = lambda: f"({R.randrange(200, 999)}) 555-{R.randrange(1000, 9999)}"
    wrong = lambda x: x[:-1] + str((int(x[-1]) + 1) % 10)
    rows, want = [], {}
    for i in range(300):
        new = [("phone", local()), ("email", f"{word()} [at] {word()}.de"), ("card", card(15))] if i % 20 == 0 else []
        no = ["1.2.3.999", wrong(card(15)), f"{word()}7435553824{word()}", "7435553824"] if i % 50 == 1 else []
        plain = [f"+1 {local()}", f"{word()}@{word()}.com", "10.1.2.3", card(16)]
        rows.append((i, " zz ".join([word(), *plain, *[m for _, m in new], *no, word()])))
        want[i] = sorted(new)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(df, pii.fit(df)).collect()
    assert all(len(r.base) == 4 for r in got)
    assert {r.doc_id: sorted((s.kind, s.match) for s in r.found if s not in r.base) for r in got} == want
