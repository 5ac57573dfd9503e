"""Operators 11 to 13: against SQL, brute force and held-out labels, on whole tables, edge cases and small fixtures."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import quality, queries, runs, text, trie

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t ", "one", "é" * 50_000, "word " * 30_000, "a b c " * 40 + "d", "x " * 23, "x " * 24, "Ab ab " * 30, "|||| ### $$$"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, twice each, tied and null ids, and columns whose names clash with those operators add."""
    rows = [(i, t, 1, "x", 0.5) for i, t in enumerate(TEXTS)] * 2 + [(None, "no id here at all", 3, "z", 1.0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string, score double").repartition(3)


def runs_by_hand(words, min_length=24, min_exponent=3):
    found = set()
    for q in range(1, len(words) // min_exponent + 1):
        begin = 0
        for i in range(len(words) - q + 1):
            if i + q < len(words) and words[i] == words[i + q]:
                continue
            length, begin = i - begin + q, i + 1
            start = i + q - length
            if length >= max(min_length, min_exponent * q):
                if not any(all(words[k] == words[k + r] for k in range(start, start + length - r)) for r in range(1, q)):
                    found.add((start, length, q))
    return sorted(found)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def kept(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(random_, letters):
    words = []
    for _ in range(random_.randint(0, 5)):
        unit = [chr(97 + random_.randrange(letters)) for _ in range(random_.randint(1, 14))]
        words += (unit * random_.randint(1, 12))[: random_.randint(1, 90)]
    return random_.choice([" ", " \n"]).join(words)


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (6, 2), (10, 4), (2, 2), (7, 3)])
def test_runs_against_all_periods(min_length, min_exponent, monkeypatch):
    random_ = random.Random(min_length)
    for n in range(60):
        monkeypatch.setattr(runs, "STEP", random_.choice([64, 1 << 20]))
        texts = [made(random_, random_.choice([1, 2, 3, 20])) for _ in range(random_.randint(1, 5))]
        data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        counts, found, joined = runs._chunk(data, offsets, min_length, min_exponent)
        for k, t in enumerate(texts):
            want = runs_by_hand(split(t), min_length, min_exponent)
            assert [tuple(r[1:]) for r in found.tolist() if r[0] == k] == want
            assert counts[k] == len(split(t)) and joined[k].decode() == kept(split(t), want)


def test_runs_of_long_texts():
    def one(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return runs._chunk(data, np.array([0, len(data)]), 24, 3)[1][:, 1:].tolist()

    assert one(["a"] * 200_000) == [[0, 200_000, 1]]
    assert one(["start", *(str(i % 777) for i in range(200_000)), "end"]) == [[1, 200_000, 777]]
    assert one([str(bin(i).count("1") % 2) for i in range(1 << 15)]) == []  # free of overlaps
    a, b = ["0"], ["0", "1"]
    while len(b) < 2000:
        a, b = b, b + a
    assert [tuple(r) for r in one(b)] == runs_by_hand(b)  # rich in runs


def test_runs_on_odd_rows(spark, odd):
    found = runs.find_runs(odd)
    assert found.columns == ["doc_id", "text", "score", "n_words", "runs", "collapsed"]
    rows = found.withColumn("best", runs.strongest(F.col("runs"))).collect()
    assert len(rows) == 2 * len(TEXTS) + 2
    for r in rows:
        words = split(r.text)
        want = [(0, 30_000, 1)] if len(words) == 30_000 else runs_by_hand(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), want, kept(words, want))
        assert (r.best is None) == (not want)
    assert runs.find_runs(odd.where("false")).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(odd, min_exponent=1)


def test_the_strongest_run(spark):
    rows = [([(0, 24, 5), (50, 48, 10), (99, 30, 6)],), ([(3, 30, 2), (3, 60, 4)],), ([],), ([(1, 10**12, 3), (0, 10**12 + 1, 3)],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>")
    assert [r.best and tuple(r.best) for r in df.select(runs.strongest(F.col("runs")).alias("best")).collect()] == [(99, 30, 6), (3, 30, 2), None, (0, 10**12 + 1, 3)]


def op13_by_hand(i, t):
    words = split(t)
    h = zlib.crc32(str(i).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = runs_by_hand(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), kept(words, found))]
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, *digests)


def test_runs_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ours = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert ours.keys() == docs.keys()
    short = [i for i in docs if len(split(docs[i])) <= 800]
    assert len(short) > 150 and any(ours[i][1] for i in short)
    assert [ours[i] for i in short] == [op13_by_hand(i, docs[i]) for i in short]


def trie_by_hand(conversations):
    """conversations: id to its turns."""
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = own + sum(saved[p] for p in children[path])
    ends = {p: ",".join(str(c) for c in sorted(members[p]) if len(conversations[c]) == len(p)) for p in members}
    return sorted(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p in members
    )


def shown(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("walk", [30, 1 << 12])
def test_trie_by_hand(spark, walk, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4 if walk < 100 else 1 << 14)
    random_ = random.Random(walk)
    texts = ["", "a", "b", "é", "a:b", "b" * 50]
    conversations = {c: [(random_.choice(["user", "", "user:1"]), random_.choice(texts)) for _ in range(random_.choice([0, 1, 2, 3, 9]))] for c in range(-20, 60)}
    conversations[77] = [("user", "a")] * 30
    conversations[78] = conversations[79] = conversations[77] + [("user", "b")]
    for c in range(100, 140):  # very many children of one node, and copies
        conversations[c] = [("system", "s"), ("user", str(c % 35))]
    rows = [(c, k + 1, *t) for c, turns in conversations.items() for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv long, rank long, role string, text string").repartition(5)
    convs = spark.createDataFrame([(c,) for c in conversations], "conv long")
    assert shown(trie.prefix_trie(df, convs, walk=walk)) == trie_by_hand(conversations)


def test_trie_query_by_hand(spark, tmp_path):
    """Ties, null turns, roles, texts and ids, repeated rows, negative ids, absent heads and conversations left without turns."""
    random_ = random.Random(3)
    rows = [(random_.randint(-9, 40), random_.choice([None, 0, 1, 1, 2, 3]), random_.choice([None, "user", "assistant"]), random_.choice([None, "", "x", "y z"]), "extra") for _ in range(260)]
    rows += rows[:20] + [(None, 1, "user", "no conversation", "extra")] + [(c, 0, "user", "only", "extra") for c in range(41, 60)]
    rows = [r for r in rows if r[0] not in (10, 50)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent_conv_id string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = defaultdict(list)
    for c, turn, role, t, _ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", t or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(head, [])[:h] + own[c][h:]
    assert any(not v for v in rebuilt.values())
    assert shown(queries.op12_prefix_trie(spark, str(tmp_path))) == trie_by_hand(rebuilt)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.spliced(trie.ranked(none))).collect() == []


def test_lists_are_ranked_in_rounds(spark):
    ids = list(range(500))
    random.Random(5).shuffle(ids)
    rows = [(i, ids[k - 1] if k % 250 else None, ids[k + 1] if k % 250 < 249 else None) for k, i in enumerate(ids)]
    found = trie.rank_list(spark.createDataFrame(rows, "id long, prev long, next long"), walk=20).collect()
    assert {r.id: r["rank"] for r in found} == {i: 250 - k % 250 for k, i in enumerate(ids)} and len(found) == 500


def ranked_right(rows):
    """The share of (label 1, label 0) pairs in which the first scores higher, ties half."""
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op11_quality(spark, sf).cache()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in docs.collect())
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and ranked_right(held) > 0.98 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert sorted((r.doc_id, r.score) for r in queries.op11_quality(spark, sf).collect()) == sorted((r.doc_id, r.score) for r in found.collect())


def test_quality_on_odd_rows(spark, odd):
    measured = quality.measure(odd.withColumn("numbers", F.lit("clash")))
    assert measured.columns == ["doc_id", "n_words", "runs", "score", "numbers"]
    model = quality.train(measured.withColumn("quality", F.col("doc_id") % 2))
    found = quality.score(measured, model)
    assert found.columns == ["doc_id", "n_words", "runs", "score"]
    rows = found.collect()
    assert len(rows) == 2 * len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1  # a null text is an empty one
    assert quality.score(measured.where("false"), model).collect() == [] and quality.measure(odd.where("false")).collect() == []
    for label in ("0", "1", "cast(null as int)", "7"):  # nothing to rank
        flat = quality.train(measured.withColumn("quality", F.expr(label)))
        assert {r.score for r in quality.score(measured, flat).collect()} == {0.5}


def test_quality_pairs_and_threshold(spark):
    good = np.array([1, 0, 1, 1, 1, 0, 1], bool)
    win, lose = quality.pairs(good)
    assert good[win].all() and not good[lose].any() and set(win) | set(lose) == set(range(7)) and len(win) == 5 * quality.ROUNDS
    assert len(set(zip(win.tolist(), lose.tolist(), strict=True))) == 10  # all there are
    assert len(quality.pairs(good[:1])[0]) == 0
    # shouting is bad: labels by one number alone are learned, whatever the share of the labels
    rows = [(i, ("WORD" if i % 7 == 0 else "word") + f" number {i}", int(i % 7 != 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    measured = quality.measure(df)
    found = quality.score(measured, quality.train(measured)).collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in found)


def test_descriptions_do_not_cross_texts():
    texts = ["", "Ab ab\n\nab", "x", "# $$ A1", "", "é é"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    together = quality.describe(data, offsets)
    for t, row in zip(texts, together, strict=True):
        alone = quality.describe(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
        assert np.allclose(row, alone) and len(row) == len(quality.NUMBERS)
    assert together[1][quality.NUMBERS.index("repeated_words")] == pytest.approx(2 / 3)
    assert len(text.AS_IS) == 256
