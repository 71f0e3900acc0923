"""Whitening, fill-in-middle and packing against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from denovospark.llm import fill_in_middle as fim
from denovospark.llm import packing, whitening
from denovospark.llm.packing import Item, Limits

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "a", "\n", "a\n", "\n\n\nx", "one\ntwo\nthree\nfour", "été\n日本\n😀😀\nz\n" * 40, "holds <P> a mark\nb", "<S>\n<M>", "x" * 5000 + "\n" + "y" * 700, "l\n" * 3000, "same\ntext", "same\ntext",
    "<|endoftext|>a <|startoftext|>", "\x01 \x01b c\x01", "It's\tWE'LL \x1c\x85 x ́y", "Σας İstanbul ﬁ ÅÅ 12345",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "of no\nid", "x"), (3, "a\nb", "x"), (3, "a\nb", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, output string")


# whitening


def plain_whitening(vectors: list, k: int):
    rows = [(i, v) for i, v in vectors if v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = [int(sum((n * c - s) ** 2 for c, s in zip(v, sums))) for v in x]
    onto = vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    each = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for v in x]) @ onto
    return rows, n, deviation, each, values[::-1][:k] / values.sum()


def test_whitening_equals_a_dense_version(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5] + 1000).tolist()) for i in range(300)]
    vectors += [(3, vectors[3][1])] * 200 + [(None, vectors[4][1])]  # a hot copy, a null id
    vectors += [(900, None), (901, [1.0] * 5 + [None]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0] * 5), (905, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, n int")
    got = whitening.whiten(df, k=4).collect()
    rows, n, deviation, each, share = plain_whitening(vectors, 4)
    assert n == 300 and len(got) == len(rows) == 501
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got) == sorted((str(i), d) for (i, _), d in zip(rows, deviation))
    assert np.allclose(got[0].explained, share, rtol=1e-9)
    want = {str(i): w for (i, _), w in zip(rows, each)}
    of = np.array([r.whitened for r in got])
    other = np.array([want[str(r.vec_id)] for r in got])
    assert np.allclose(of, other * np.sign((of * other).sum(axis=0)), atol=1e-7)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.whitened, int(r.deviation), r.identity_error) for r in one] == [(1, [], 0, 0.0)] * 2
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5e9]) for i in range(9)], schema)).collect()
    assert all(len(r.whitened) == 1 for r in line)  # of rank one, and wide entries
    large = whitening.Centre.of(10**9, [0, 10**9])
    assert [int(d) for d in large.deviation(np.array([[3, 5], [10**6, 0]])).to_pylist()] == [(3 * 10**9) ** 2 + (4 * 10**9) ** 2, 10**30 + 10**18]


@pytest.mark.parametrize(("d", "k", "block"), [(64, 16, 32), (150, 8, 16), (5, 16, 32), (90, 16, 16)])
def test_iteration_is_certified_without_the_matrix(d, k, block):
    """Flat spectra, on which the eigenvalues lie close together, in blocks that are much smaller than the space."""
    x = np.floor(64 * np.random.default_rng(d).standard_normal((4000, d)))
    x -= x.mean(axis=0)
    v = x.T @ x / len(x)
    found = whitening.leading(lambda q: (v @ q, float(np.trace(v))), d, min(k, d), block)
    assert found.passes < 80 and found.residual < 1e-9
    assert np.allclose(found.values, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(min(k, d))).max() < 1e-12
    if d > block:
        with pytest.raises(RuntimeError):
            whitening.leading(lambda q: (v @ q, 1.0), d, min(k, d), block, most=1)


# fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs):
    made = fim.fill_in_middle(docs).select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(str, ((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made))) == sorted(str((r.doc_id, plain_fim(r.doc_id, r.text))) for r in docs.collect())
    assert sorted(r.back for r in made) == sorted(r.text or "" for r in docs.collect())
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    some = fim.fill_in_middle(docs, rate=0)
    assert {r.form for r in some.collect()} == {"plain"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.001, 0.3, 0.999, 1.0])
def test_rank_and_select(share):
    bits = np.random.default_rng(3).random(5000) < share
    v = fim.BitVector(bits)
    assert v.total == bits.sum()
    assert (v.rank(np.arange(5001)) == np.concatenate([[0], np.cumsum(bits)])).all()
    assert (v.select(np.arange(v.total)) == np.flatnonzero(bits)).all()


def test_groups_of_texts_and_one_larger_than_a_group(monkeypatch, docs):
    monkeypatch.setattr(fim, "GROUP_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(map(str, range(len(TEXTS)))), pa.array([(t or "").encode() for t in TEXTS])], names=["id", "key", "text"])
    parts = list(fim._formed(iter([batch]), 7, 100, 50))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == len(TEXTS)
    rows = [r for p in parts for r in p.to_pylist()]
    assert {str((r["id"], r["n"], r["form"], r["output"].decode())) for r in rows} <= {str((r.doc_id, r.n, r.form, r.output)) for r in fim.fill_in_middle(docs).collect()}


# packing


def held_to(pieces: list, examples: dict, limits: Limits) -> dict:
    """Check pieces (example, start, ids, loss, sequence, offset) against examples, and give the fill of each sequence."""
    by_example, by_sequence = defaultdict(list), defaultdict(list)
    for example, start, ids, loss, sequence, offset in pieces:
        by_example[example].append((start, ids))
        by_sequence[sequence].append((offset, len(ids), loss))
    for example, ids in examples.items():
        at = 0
        for start, part in sorted(by_example.pop(example, [])):
            assert start == at and len(part)
            at += len(part)
            assert list(part) == list(ids[start:at])
        assert at == len(ids)
    assert not by_example
    for parts in by_sequence.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(loss for *_, loss in parts) <= limits.loss
        assert at == limits.tokens or at & (at - 1) == 0
    return {s: sum(n for _, n, _ in p) for s, p in by_sequence.items()}


@pytest.mark.parametrize("limits", [Limits(64, 8, 64), Limits(64, 3, 20), Limits(16, 1, 16), Limits(100, 50, 7), Limits(1, 1, 1)])
@pytest.mark.parametrize("last", [True, False])
def test_packing_keeps_to_all_limits(limits, last):
    rng = np.random.default_rng(limits.tokens + limits.segments)
    examples = {i: rng.integers(0, 50_000, n).astype(np.uint32) for i, n in enumerate([*rng.integers(0, 40, 700), 1000, 64, 65])}
    masks = {i: None if i % 3 == 0 else (rng.random(len(x)) < 0.4).astype(np.uint8) for i, x in examples.items()}
    out = list(packing._packed((Item(i, 0, len(x), x, masks[i]) for i, x in examples.items()), limits, 5, last))
    rest = [p for s, _, p in out if s is None]
    assert sum(len(p.ids) for p in rest) < limits.tokens and not (last and rest)
    done = {i: list(x) for i, x in examples.items()}
    if rest:
        gone = {(p.example, p.start) for p in rest}
        assert len(gone) == len(rest)
        return
    held_to([(p.example, p.start, list(p.ids), p.loss, s, at) for s, at, p in out], done, limits)


def test_whole_examples_fill_sequences_without_cuts_where_they_can():
    sizes = [40, 24, 30, 34, 50, 14, 64] * 50
    out = list(packing._packed((Item(i, 0, n, np.zeros(n, np.uint32), None) for i, n in enumerate(sizes)), Limits(64, 8, 64), 0, True))
    assert len(out) == len(sizes) and len({s for s, *_ in out}) == sum(sizes) // 64


def test_documents_are_packed_whole(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    limits = Limits(256, 16, 256)
    source = docs.repartition(3).withColumn("doc_id", F.monotonically_increasing_id()).persist()
    rows = packing.pack_texts(source, WORDS, limits).withColumn("crc", F.crc32("ids")).collect()
    examples = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in source.collect()}
    held_to([(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.loss_tokens, r.sequence_id, r.offset) for r in rows], examples, limits)
    assert all(r.crc == zlib.crc32(r.ids) and r.doc_tokens == len(examples[r.doc_id]) and r.length == len(r.ids) // 4 for r in rows)
    again = packing.pack_texts(docs.select("text", F.lit("x").alias("doc_id")), WORDS, limits)  # one id for all rows
    assert again.agg(F.sum("length")).first()[0] == sum(map(len, examples.values()))
    assert packing.pack_texts(docs.limit(0), WORDS).count() == 0
    source.unpersist()


def test_examples_with_masks(spark):
    rows = [(1, [1, 2, 3], [False, True, True]), (None, [4] * 9, None), (2, None, None), (3, [], []), (1, [1, 2, 3], [False, True, True])]
    df = spark.createDataFrame(rows, "id int, ids array<int>, mask array<boolean>")
    got = packing.pack_examples(df, Limits(8, 4, 5), mask_col="mask").collect()
    assert sum(r.length for r in got) == 15 and sum(r.loss_tokens for r in got) == 13
    assert sorted((str(r.id), r.doc_tokens) for r in got if r.start == 0) == [("1", 3), ("1", 3), ("None", 9)]
    with pytest.raises(Exception, match="marks"):
        packing.pack_examples(spark.createDataFrame([(1, [1, 2], [True])], df.schema), mask_col="mask").count()
    with pytest.raises(ValueError):
        Limits(0, 1, 1)


@pytest.mark.parametrize("bare", [True, False])
def test_words_are_encoded_as_the_library_does(monkeypatch, bare):
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    assert words.bare
    words.bare = words.bare if bare else None
    monkeypatch.setattr(packing, "MEMO_WORDS", 3)  # forgotten between the calls
    texts = [t or "" for t in TEXTS] * 2 + ["a\x00b\x1c\x7f é\x85É \xa0x\xad İı ŸßſŒ", "don't I'LL 'S ''ve _x_ 1²³½ ª", "<|ENDOFTEXT|> <|endoftext|", "á á ´ ¸", "\v\f\r a"]
    letters = [chr(c) for c in range(0x250)]
    texts += ["".join(letters), " ".join(letters), "x".join(letters), " ".join(c + "a" + c for c in letters), " ".join(map(chr, range(0x250, 0x3000, 7)))]
    for text in texts:
        assert next(words.encode(pa.array([text]), None)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in words.encode(pa.array(texts), 2)] == [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
