import hashlib

import public_tokenizers
import pytest

from denovospark.llm import bpe_tree, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "don't  stop\n\n\nnow   ", "x" * 9000, "ab" * 5000 + " c", "<|endoftext|>" * 300, "a<|endoftext|> b " * 200, ("word  " * 50 + "\n\t \n" + " " * 300) * 6,
    "été 日本語の文章です。😀😀" * 300, "1234567890" * 700, "it's we'll I'd " * 400, "   \x1f x" * 500, "!?" * 3000 + " tail", " " * 7000, "\n" * 5000 + "end", "é" * 4097,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "twice", "x"), (3, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize(("step", "overlap"), [(2048, 64), (64, 17), (100, 40)])
def test_counts_equal_the_library(docs, step, overlap):
    tokenizer = token_counts._tokenizer(JSON)
    got = token_counts.count_tokens(docs, JSON, step=step, overlap=overlap).collect()
    want = {(r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()}
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert step > 1000 or any(r.n_widened for r in got)


@pytest.mark.parametrize("leaf", [1, 7, 300, 4096])
def test_tree_equals_the_library(leaf):
    encode, pieces, _ = bpe_tree._codec(RANKS)
    for text in TEXTS:
        text = (text or "")[: 600 if leaf < 10 else None]
        ids = bpe_tree.encode_tree(text, encode, pieces, leaf)
        assert ids == encode(text)
        assert bpe_tree.decode_tree(ids, pieces, leaf) == text.encode()


def test_digests(docs):
    encode = bpe_tree._codec(RANKS)[0]
    for r in bpe_tree.digest_bpe(docs, RANKS).join(docs.withColumnRenamed("n_tokens", "other").dropna(subset="doc_id").dropDuplicates(["doc_id"]), "doc_id").collect():
        ids = encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe_tree.decode_bpe(bpe_tree.encode_bpe(docs, RANKS), RANKS).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((r.text or "").encode() for r in docs.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, JSON).count() == 0
    assert bpe_tree.digest_bpe(none, RANKS).count() == 0


@pytest.mark.parametrize("text", ["x" * 2_000_000, " " * 700_000 + "end"])
def test_long_texts_without_boundaries(text):
    """Work grows with the length: few encodings of the whole, however many chunks there are."""
    tokenizer, done = token_counts._tokenizer(JSON), []

    def encode(part):
        done.append(len(part))
        return tokenizer.encode(part, add_special_tokens=False)

    first = tokenizer.encode_batch(token_counts._chunks(text, 2048, 64), add_special_tokens=False)
    assert token_counts.splice(text, encode, first, 2048, 64)[0] == len(tokenizer.encode(text, add_special_tokens=False))
    assert sum(done) <= 4 * len(text)
