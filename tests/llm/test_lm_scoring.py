import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from denovospark.llm import lm_scoring as lm


def brute(rows, folds=10):
    """The model again with dictionaries and unrounded estimates."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        docs.append((i, zlib.crc32(str(i).encode()) % folds if i is not None else folds - 1, [*words, 0]))

    def counted(which):
        one, two = Counter(), Counter()
        for _, f, tokens in docs:
            if which(f):
                one.update(tokens)
                two.update(zip([0, *tokens], tokens, strict=False))
        return one, two, sum(one.values()), len(one)

    def estimates(tokens, c):
        one, two, n, v = c
        for h, w in zip([0, *tokens], tokens, strict=False):
            yield one[h].bit_length(), two[h, w] / max(one[h], 1), one[w] / max(n, 1), 1 / (v + 1)

    rest, whole = counted(lambda f: f > 1), counted(lambda f: f > 0)
    held = [e for _, f, t in docs if f == 1 for e in estimates(t, rest)]
    weights = {}
    for b in {e[0] for e in held}:
        start = np.array([0.4, 0.5, 0.1] if b else [0, 0.9, 0.1])
        f, a = np.array([e[1:] for e in held if e[0] == b]), start
        for _ in range(60):
            s = a * f
            s /= s.sum(1, keepdims=True)
            a = s.sum(0) + start
            a /= a.sum()
        weights[b] = a
    one, _, n, v = whole
    out = []
    for i, f, tokens in docs:
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = sum(math.log10(np.dot(weights.get(e[0], [0.4, 0.5, 0.1] if e[0] else [0, 0.9, 0.1]), e[1:])) for e in estimates(tokens, whole))
        out.append((i, f == 0, len(tokens), sum(one[w] > 0 for w in tokens), n, base, score))
    return out


@pytest.mark.parametrize(("block", "fan"), [(40, 256), (200, 4), (1_000_000, 256)])
def test_equals_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(lm, "FAN", fan)
    words = "the of and Tion ing ble ou 日本 é x".split(" ")
    rows = [(i, " ".join(words[(i * k + k // 3) % (3 + i % 8)] for k in range(i % 40))) for i in range(300)]
    rows += [(7, rows[7][1]), (None, "the of"), (1001, None), (1002, ""), (1003, "new words only"), (1004, "the " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    key = lambda r: (str(r[0]), r[2])
    got, want = sorted(lm.score_documents(docs, block=block).collect(), key=key), sorted(brute(rows), key=key)
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [r.score for r in got] == pytest.approx([w[6] for w in want], rel=0.01)  # estimates are rounded for the weights


def test_weights_are_shares():
    weights = lm.expectation_maximisation([(3, -16, -32, 100), (3, lm.NONE, lm.NONE, 3), (0, lm.NONE, -32, 5)], 50)
    assert np.allclose(weights.sum(1), 1) and (weights[:, 2] > 0).all() and weights[0, 0] == 0


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score)


def test_messages_grow_with_the_blocks(spark, monkeypatch):
    """However many ranges there are, a block's questions are FAN for each of its two tables and step at most."""
    monkeypatch.setattr(lm, "FAN", 4)
    asked, answered = [], lm.answered

    def counted(questions, blocks, ranges, parts):
        asked.append((questions.count(), blocks))
        return answered(questions, blocks, ranges, parts)

    monkeypatch.setattr(lm, "answered", counted)
    rows = [(i, " ".join(f"w{i * k % 211}" for k in range(60))) for i in range(110)]
    score = lambda n: lm.score_documents(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(1), block=50).count()
    for n in (1, 10, 110):
        asked.clear()
        assert score(n) == n
        assert asked[0][1] == n and all(count <= 2 * 4 * (n + 16) for count, _ in asked)
    assert len(asked) >= 3


def test_other_ids(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id for r in lm.score_documents(docs).collect()} == {"a", "b"}
    assert {r.doc_id for r in lm.score_documents(docs.selectExpr("cast(ascii(doc_id) as decimal(20, 0)) doc_id", "text")).collect()} == {97, 98}
