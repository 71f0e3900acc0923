import hashlib
import random

import corpus_pipeline
from denovospark.llm import bpe_tree

BAD = ["pathetic", "worthless", "disgusting", "idiot", "scum", "moron"]
CARD = "4929348385146306"


def test_planted_cases(spark, tmp_path):
    draw = random.Random(5)
    word = lambda: f"{draw.choice(['th', 'er', 'on', 'an'])}{draw.choice(['ing', 'ed', 'ou', 'nt'])}{draw.choice('abcdefghij')}{draw.choice(['', 'ly', 'es'])}"
    text = lambda n=60: " ".join(word() for _ in range(n))
    item = "the clerk counts every seventh apple in the cellar and writes the sum down in a small green book before noon"
    docs, labels = {}, []
    for i in range(900):
        words = text().split(" ")
        if i % 6 == 0:
            words[3::9] = [BAD[(i + k) % 6] for k in range(len(words[3::9]))]
        docs[i] = " ".join(words)
        if i < 700:
            labels.append((i, 1, int(i % 6 == 0)))
    docs[1001], docs[1002] = docs[1], docs[2] + " end"
    docs[1003], docs[1004] = text() + " " + item + " " + text(), text() + f" card {CARD} " + text()
    docs[1005], docs[1006], docs[1007] = None, "", text(9000)
    toxic = {i for i in range(900) if i % 6 == 0}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()] + [(7, docs[7], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not toxic & set(got)
    assert set(got) == set(docs) - toxic - {1001, 1002, 1003}
    encode = bpe_tree._codec(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))[0]
    for i, r in got.items():
        said = docs[i] or ""
        if i != 1004:
            assert r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, encode(said))).encode()).hexdigest()
    assert got[1004].decoded_sha256 != hashlib.sha256(docs[1004].encode()).hexdigest()
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, source.limit(0), str(tmp_path)).columns == source.columns


def test_repeated_ids(spark, tmp_path):
    """Equal rows of an id are one; its different texts all stay, whatever other columns are named."""
    words = lambda a: " ".join(f"w{a}x{k}" for k in range(30))
    rows = [(1, words(1), "z", 1), (1, words(1), "y", 2), (1, words(2), "y", 3), (2, words(1), "x", 4), (None, words(1), "n", 5), (None, words(1), "n", 5), (3, None, "a", 6), (3, None, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _private string, member int").repartition(3)
    got = {(r.doc_id, r.text, r._private, r.member) for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()}
    assert got == {(1, words(1), "y", 2), (1, words(2), "y", 3), (None, words(1), "n", 5), (3, None, "a", 6)}
    assert corpus_pipeline.near_copies(spark, docs, str(tmp_path)).columns == docs.columns
