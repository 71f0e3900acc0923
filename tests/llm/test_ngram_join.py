import random
import re

import numpy as np

from denovospark.llm import ngram_join as j


def brute(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def test_components_equal_brute_force(spark):
    draw = random.Random(3)
    word = lambda: f"{draw.choice('abcdefgh')}{draw.randrange(300)}"
    rows, passage = [], [word() for _ in range(60)]
    for family in range(12):
        text = [word() for _ in range(draw.choice([30, 80, 200]))]
        for _ in range(draw.choice([2, 5, 25])):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
                copy[draw.randrange(len(copy))] = word()
            if family % 3 == 0:
                copy = copy[: len(copy) - draw.randrange(8)]
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(60)]
    rows += [None, "", " \n", "a b", "A  b", "a b c", "a b c d e", "a b c d e"]
    rows.append("x " * 20_000)
    # a chain: each links with the next alone
    base = [word() for _ in range(100)]
    for k in range(6):
        rows.append(" ".join(base))
        base = base[5:] + [word() for _ in range(5)]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(i * 3 + 1, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n string").repartition(5)
    got = {tuple(r) for r in j.ngram_components(docs).collect()}
    assert got == brute([(i * 3 + 1, t) for i, t in enumerate(rows)])


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, j.ngram_components(docs).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (2, 0, 2)], key=str)


def test_empty(spark):
    assert j.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_equals_pairwise():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 50)).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.append(sets[k][: len(sets[k]) - 1], np.uint64(99))) for k in range(100)] + [sets[0], sets[0][:-2] if len(sets[0]) > 2 else sets[0]]
    tree = j.PrefixTree(sets)
    for probe in sets[::7]:
        want = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))}
        assert {k for k, _ in tree.similar(probe, 75)} == want


def test_messages_in_steps(spark, monkeypatch):
    """More ranges than an array is cut into at once: the same links, and as many messages a step as parts times batches."""
    rows = [(i, " ".join(f"w{(i // 3) * 50 + k}" for k in range(40 + i % 3))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert j.fans(50) == [50] and j.fans(65) == [9, 9]
    counts, dealt = [], j.dealt

    def counted(messages, steps, blocks):
        out = dealt(messages, steps, blocks)
        counts.extend([len(steps), messages.count(), out.count(), blocks])
        return out

    monkeypatch.setattr(j, "FAN", 3)
    monkeypatch.setattr(j, "dealt", counted)
    assert {tuple(r) for r in j.ngram_components(docs).collect()} == want
    steps, first, last, blocks = counts
    assert steps == 4 and first <= 3 * blocks and last <= 3 * (blocks + 27)


def test_sets_by_join(spark, monkeypatch):
    """More classes than a filter is broadcast for; small blocks and trees."""
    draw = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.choice([1, 1, 2, 4])):
            words[draw.randrange(80)] = f"x{draw.randrange(999)}"
        rows.append((i * 5 % 91, " ".join(words)))
    monkeypatch.setattr(j, "FILTER_CLASSES", 0)
    monkeypatch.setattr(j, "BLOCK", 8)
    assert {tuple(r) for r in j.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_words_are_told_apart():
    hashes = lambda t: j.Shingles().words(t).tolist()
    assert hashes("Ab ab\x0bAB") == hashes("ab") * 3 and hashes(None) == hashes(" \t\r\n") == []
    words = [*{w for n in range(4) for w in map("".join, __import__("itertools").product("abc\u00e9\x1f", repeat=n + 1))}]
    assert len(set(hashes(" ".join(words)))) == len(words)
    assert len(hashes("x " * 300_000)) == 300_000 and len(set(hashes("x " * 300_000))) == 1
