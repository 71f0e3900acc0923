import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from denovospark.llm import quality_rules as q
from denovospark.llm import toxicity as t

SPACE = " \t\n\v\f\r"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = (text or "").split("\n")
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        sum(any(c not in SPACE for c in x) and x in lines[:k] for k, x in enumerate(lines)), len(covered),
    )


TEXTS = [None, "", " \n\t", "a b c a b c", "x x x x x", "one\ntwo\none\n\n\n one\n", "a b c d a b c e b c d f" * 3, "#*$ %& |<> é é z", "w " * 3000, "la la la di la la la"]


def test_stats():
    assert [q.text_stats(x)[:5] for x in TEXTS] == [brute(x) for x in TEXTS]


@pytest.mark.parametrize(("k", "n", "delta"), [(0, 50, 0.05), (3, 200, 0.01), (40, 90, 0.001)])
def test_exact_bound(k, n, delta):
    p = q.binomial_upper(k, n, delta)
    assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), delta, rel_tol=1e-6)


def test_certified_levels():
    assert q.certified([5000, 0, 0, 900], [0, 0, 70, 0], 0.01, 1e-3) == 2  # the third isn't certified
    assert q.certified([5000, 0, 900, 0], [0, 10, 70, 90], 0.01, 1e-3) == 1  # the sequence ends there
    assert q.certified([5000, 1, 0, 0], [10, 50, 0, 0], 0.01, 1e-3) == 1  # of equals the loosest
    assert q.certified([20, 0, 0], [0, 0, 50], 0.01, 1e-3) == 0  # too few to certify anything
    assert q.certified([0, 0], [5, 5], 0.01, 1e-3) == 0


def verdicts(rows, labels, alpha=0.03, delta=0.05):
    """(id, kept) by definition: every level tried on every labelled document, bounds by summing the binomial."""
    stats = [(i, lang, dict(zip(q.STATS, q.text_stats(text), strict=True))) for i, text, lang in rows]
    failed = lambda s: s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
    rejects = lambda s, level: level > 0 and any(s[r.top] / max(s[r.bottom], 1) >= r.cutoffs[level - 1] for r in q.RULES)
    good = {}
    for i, y in labels:
        if i is not None and y is not None:
            good[i] = min(good.get(i, 1), int(y == 1))
    one = {}  # of an id the text of least digest, of texts in a stratum one
    for (i, lang, s), (_, text, _) in zip(stats, rows, strict=True):
        if i in good and not failed(s):
            of = (hashlib.md5(text.encode()).hexdigest(), lang is not None, lang or "", s)
            one[i] = min(one.get(i, of), of, key=lambda x: x[:3])
    texts = {}
    for i, (digest, _, _, s) in one.items():
        lang = one[i][2] if one[i][1] else None
        texts[lang, digest] = (lang, min(good[i], texts.get((lang, digest), (0, 1))[1]), s)
    held = list(texts.values())
    strata, level_of = {lang for lang, _, _ in held}, {}
    for lang in strata:
        ours = [(y, s) for x, y, s in held if x == lang]
        best = caught = 0
        for level in range(1, q.LEVELS + 1):
            n, lost = sum(y for y, _ in ours), sum(y and rejects(s, level) for y, s in ours)
            # the upper bound is at most alpha if so few losses have at most this chance at alpha
            if n == 0 or sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(lost + 1)) > delta / len(strata):
                break
            if (now := sum(not y and rejects(s, level) for y, s in ours)) > caught:
                best, caught = level, now
        level_of[lang] = best
    return sorted(((i, not failed(s) and not rejects(s, level_of.get(lang, 0))) for i, lang, s in stats), key=str)


def test_verdicts_equal_brute_force(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        lang = draw.choice(["en", "en", "en", "de", "fr", None, "xx"])
        bad = draw.random() < 0.15
        share = draw.choice([0, 0, 0.03, 0.1, 0.2, 0.4, 0.9]) if bad else draw.choice([0] * 30 + [0.06, 0.3])
        words = [f"w{draw.randrange(5000)}" + "%" * (draw.random() < share) for _ in range(draw.choice([30, 60, 120]))]
        rows.append((i % 2990 if i else None, "\n".join([" ".join(words)] * draw.choice([1, 1, 1, 1, 3])) if i % 97 else None, lang))
        if lang != "xx" and i % 3:
            labels.append((i, None if i % 101 == 0 else int(not bad)))
    labels += [(4, 0), (5, 1), (None, 1), (99999, 1)]
    rows += rows[:400] + [(i + 5000, text, lang) for i, text, lang in rows[100:300]]
    labels += [(i + 5000, i % 2) for i, _, _ in rows[100:300]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, level string").repartition(4)
    got = q.apply_quality_rules(docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, stratum string"))
    want = verdicts(rows, labels)
    assert sorted(((r.doc_id, r.kept) for r in got.collect()), key=str) == want
    assert got.filter("not kept and not base_failed").count() > 20 and got.filter("level > 0").count() > 1000
    assert got.filter("stratum = 'xx' and level > 0").count() == 0


def test_repeated_rows_and_equal_texts_are_one_draw(spark):
    good = [(i, f"good {i} " + " ".join(f"g{i}x{k}" for k in range(60)), "en") for i in range(20)]
    bad = [(100 + i, " ".join(f"b{i}x{k}%%" for k in range(60)), "en") for i in range(20)]
    schema = "doc_id long, text string, lang string"
    labels = [(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad]
    for rows, names in ((good + bad, labels), ((good + bad) * 10, labels), (good + bad + [(1000 + 20 * n + i, t, x) for n in range(9) for i, t, x in good], labels + [(1000 + i, 1) for i in range(180)])):
        got = q.apply_quality_rules(spark.createDataFrame(rows, schema), spark.createDataFrame(names, "doc_id long, quality int")).collect()
        assert all(r.kept and r.level == 0 for r in got)


def test_rules_on_a_table(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, (" ".join(f"{i}w{k}%%%" for k in range(60)) if i % 4 == 0 else f"{i} {clean}"), "en", "x") for i in range(4000)]
    rows += [(None, clean, None, "x"), (1, "1 " + clean, "en", "x"), (9999, None, "fr", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, "x") for i in range(4000)] + [(None, 1, ""), (5, None, "")], "doc_id long, quality int, n_words string")
    got = q.apply_quality_rules(docs, labels)
    assert got.count() == len(rows)
    assert got.filter("doc_id % 4 = 0 and kept").count() == 0
    assert got.filter("doc_id % 4 != 0 and not kept and doc_id < 4000").count() == 0
    assert got.filter("doc_id = 9999 and base_failed and not kept and n_words = 0").count() == 1
    assert q.apply_quality_rules(docs, labels.limit(0)).filter("not kept and not base_failed").count() == 0
    assert q.apply_quality_rules(docs.limit(0), labels).count() == 0


def test_toxicity_held_out(spark):
    bad = ["pathetic", "worthless", "disgusting", "idiot", "scum"]
    rows, labels = [], []
    for i in range(1500):
        words = [f"{'abcdefghij'[(i * k) % 10]}{'lmnop'[k % 5]}ion{(i + k) % 37}" for k in range(60)]
        if i % 5 == 0:
            words[3::7] = [bad[(i + k) % 5] for k in range(len(words[3::7]))]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 5 == 0), "x"))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (7, rows[7][1], "x"), (8888, "", "x"), (8889, "idiot " * 50_000, "x")], "doc_id long, text string, score string")
    table = spark.createDataFrame([*labels, (None, 1, ""), (3, None, "")], "doc_id long, toxic int, text string")
    got = t.score_toxicity(docs, table).collect()
    assert len(got) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 200
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)
    assert {r.predicted for r in got if r.doc_id == 8889} == {1} and {r.predicted for r in got if r.doc_id == 8888} == {0}


def test_toxicity_with_label_noise_quotes_and_everyday_phrases():
    """Ordinary texts quote each abuse word, one label in 47 is wrong, half the toxic texts only hold a phrase of everyday words."""
    draw = random.Random(1)
    bad = ["pathetic", "worthless", "disgusting", "idiot", "scum"]
    everyday = "you all should go back where they came from once and for good now".split()
    rows = []
    for i in range(2000):
        words = [f"{draw.choice('abcdefghij')}{draw.choice('lmnop')}ion{draw.randrange(37)}" for _ in range(60)]
        for k in draw.sample(range(60), 12):
            words[k] = draw.choice(everyday)
        toxic = i % 5 == 0
        if toxic and i % 2:
            words[20:20] = ["go", "back", "where", "they", "came", "from"]
        elif toxic:
            words[3::7] = [draw.choice(bad) for _ in words[3::7]]
        elif i % 25 == 1:
            words[10] = bad[i // 25 % 5]
        rows.append((" ".join(words), int(toxic), i))
    model = t.fit([(text, y if i % 47 else 1 - y, draw.random() < 0.25) for text, y, i in rows if i % 3])
    meter = t.Meter(model.ordinary, model.toxic, model.window)
    said = t._design(np.array([meter.features(text) for text, _, i in rows if i % 3 == 0])) @ np.array(model.weights) >= 0
    truth = np.array([y for _, y, i in rows if i % 3 == 0]) == 1
    words = np.array([i % 2 == 0 for _, _, i in rows if i % 3 == 0])
    assert said[truth & words].mean() >= 0.95 and said[truth & ~words].mean() >= 0.9 and said[~truth].mean() <= 0.03


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_toxic_texts_to_learn_from(n):
    plain = [(f"plain words about the weather {i} and nothing else", 0, i % 2 == 0) for i in range(40)]
    model = t.fit(plain + [("you are vile scum", 1, False)] * n + [("vile scum again", 1, True)])
    score = lambda m, *texts: [p for _, ps, _ in t._judged(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), m, 0) for p in ps]
    assert all(0 <= p <= 1 for p in score(model, "vile scum", ""))
    assert score(t.fit(plain + [("vile scum again", 1, True)]), "x")[0] < 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in t.score_toxicity(docs, labels).collect()] == [0]
    assert t.score_toxicity(docs.limit(0), labels).withColumn("x", F.lit(1)).count() == 0


def test_scores_equal_brute_force(spark):
    """The scores of a table against the model's definition: each window compressed with each dictionary by itself, nothing kept."""
    import zstandard

    draw = random.Random(2)
    rows = []
    for i in range(600):
        words = [f"{draw.choice('abcdefghij')}{draw.choice('lmnop')}ion{draw.randrange(37)}" for _ in range(draw.choice([0, 1, 3, 60, 61]))]
        rows.append((i, " ".join(words[:30] + ["You", "disgusting", "IDIOT"] * (i % 4 == 0 and len(words) > 30) + words[30:]), i % 4 == 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    sample = t.labelled_sample(docs, labels, "doc_id", "text", "toxic", F.lit(True), t.MAX_TOXIC, t.MAX_ORDINARY, t.MAX_BYTES)
    assert len(sample) == len({x for _, x, _ in rows})
    model = t.fit(t.labelled_sample(docs, labels, "doc_id", "text", "toxic", t.id_fold(F.col("doc_id"), 5) != 0, t.MAX_TOXIC, t.MAX_ORDINARY, t.MAX_BYTES))
    parameters = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(dictionary, data):
        content = zstandard.ZstdCompressionDict(dictionary + b"ABCDEFGHIJKLMNOP", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=content, compression_params=parameters).compress(data))

    def score(text):
        words = text.lower().split()
        starts = range(0, max(len(words) - 2, 1), 2) if words else []
        windows = [" ".join(words[k : k + 4]).encode() for k in starts]
        gains = [length(model.ordinary, d) - length(model.toxic, d) for d in (b"ABCDEFGHIJKLMNOP " + w + b" QZXJVKWYBFPMGCHUQX" for w in windows)]
        counts = [sum(g >= least for g in gains) for least in t.GAINS]
        n = len(windows)
        x = [math.log1p(c) for c in [*counts, n]] + [10 * counts[k] / max(n, 1) for k in (1, 3)] + [1]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    texts = {i: x for i, x, _ in rows}
    for r in t.score_toxicity(docs, labels).filter("doc_id % 7 = 0").collect():
        assert math.isclose(r.score, score(texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-12)


def test_training_reads_whole_texts():
    """What tells toxic text may stand behind the first thousands of words, in ordinary and in toxic texts."""
    plain = lambda k: " ".join(f"{'abcdefghij'[(k * n) % 10]}{'lmnop'[n % 5]}ion{(k + n) % 37}" for n in range(2200))
    rows = [(f"{plain(k)} {'pathetic worthless scum' if k % 2 else 'quiet gentle words'}", k % 2, k % 4 < 2) for k in range(80)]
    model = t.fit([*rows, ("", 0, False), ("a", 1, False)])
    meter = t.Meter(model.ordinary, model.toxic, model.window)
    assert meter.gain[b"pathetic worthless scum"] >= 5 > meter.gain[b"quiet gentle words"]


def test_training_texts_stay_out_of_the_driver(spark, monkeypatch):
    """The model is learnt in a task, equal to that of the driver, and only it is collected."""
    rows = [(i, f"a plain text number {i} about trees and rivers" + (" you vile worthless scum" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sizes = ("doc_id", "text", "toxic", F.lit(True), t.MAX_TOXIC, t.MAX_ORDINARY, t.MAX_BYTES)
    assert t.fit_in_task(t.drawn_texts(docs, labels, *sizes)) == t.fit(t.labelled_sample(docs, labels, *sizes))
    assert t.fit_in_task(t.drawn_texts(docs, labels.limit(0), *sizes)) == t.fit([])
    monkeypatch.setattr(t, "labelled_sample", None)
    assert t.without_toxic(docs, labels).count() < 300
