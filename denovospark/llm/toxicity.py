"""Operator 10: toxicity by compression distance.

Two zstandard dictionaries are trained: one on labelled ordinary text, one on that and the telling parts of labelled toxic
text, so that everyday words cost the same in both. Parts are runs of bytes, from within a word to several words long, and tell if
more of the toxic texts have them than of the ordinary ones, beyond chance by a likelihood ratio test of both shares:
a word that ordinary texts quote, or that a wrong label puts there, still tells if toxic texts have it more often, and so
does a phrase of everyday words. Overlapping windows of WINDOW words are compressed with each dictionary alone; the second
length is shorter where the window holds what toxic text has more of. The differences that count, and how much they weigh, are calibrated on
labelled documents that the dictionaries haven't seen: a document's numbers of windows at or above each difference go
through a logistic curve. Windows of a few bytes can be compressed because they stand between a preamble that both dictionaries hold,
as zstandard gives up on input that it can't shorten, and a tail, as it doesn't search the last bytes of its input. Both are
made of capitals, which no window holds.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, id_fold, lower_words, mix, released

_PREAMBLE, _TAIL = b"ABCDEFGHIJKLMNOP", b"QZXJVKWYBFPMGCHUQX"
#: Saved bytes from which a window counts, one feature each.
GAINS = (2, 3, 4, 5, 6, 7, 8)
#: Words of a window; windows begin every half of that, so each run of half a window's words and one more is whole in one.
WINDOW = 4
#: Lengths in bytes of the runs that are compared, and the log likelihood ratio (twice it) from which a higher share tells:
#: by chance one of some 100,000 runs has it.
RUNS, LEAST = (5, 8, 16), 20.0
#: Bounds of what is learnt from: labelled toxic and ordinary texts, bytes of one, and snippets that the ordinary dictionary is trained on.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES, MAX_SNIPPETS = 4000, 6000, 16_384, 100_000
#: Measured windows that a task keeps at a time.
CACHE = 1 << 17


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    window: int = WINDOW


def _windows(words: list[bytes], size: int) -> list[bytes]:
    step = max(size // 2, 1)
    return [b" ".join(words[k : k + size]) for k in range(0, max(len(words) - size + step, min(len(words), 1)), step)]


class Meter:
    """Bytes that the toxic dictionary saves against the ordinary one, by window."""

    def __init__(self, ordinary: bytes, toxic: bytes, window: int) -> None:
        import zstandard as z

        parameters = z.ZstdCompressionParameters.from_level(3, min_match=4, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            return z.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

        one, two = compressor(ordinary + _PREAMBLE), compressor(toxic + _PREAMBLE)

        def gain(window: bytes) -> int:
            data = _PREAMBLE + b" " + window + b" " + _TAIL
            return len(one(data)) - len(two(data))

        self.window, self.gain = window, Memo(gain, CACHE)

    def features(self, text: str | None) -> list[int]:
        """At each of GAINS, how many windows save so much; last, the number of windows."""
        windows = _windows(lower_words(text), self.window)
        found = Counter(map(self.gain.__getitem__, windows))
        return [sum(n for g, n in found.items() if g >= least) for least in GAINS] + [len(windows)]


def _design(counts: np.ndarray) -> np.ndarray:
    """Numbers of windows on a log scale, the share of the strongest, and a constant."""
    x = np.log1p(counts.astype(float))
    share = counts[:, :-1] / np.maximum(counts[:, -1:], 1)
    return np.hstack([x, 10 * share[:, [1, 3]], np.ones((len(counts), 1))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _runs(text: bytes, length: int) -> np.ndarray:
    """A number for each run of ``length`` bytes, by its start: exact up to 8 bytes, a 64-bit hash beyond."""
    if len(text) < length:
        return np.empty(0, np.uint64)
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    size = min(length, 8)
    out = np.zeros(len(x) - size + 1, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | x[k : len(x) - size + 1 + k]
    return mix(mix(out[:-8]) * np.uint64(3) + out[8:]) if length == 16 else mix(out)


def _among(runs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which of ``runs`` are among the sorted ``codes``."""
    return codes[np.minimum(np.searchsorted(codes, runs), len(codes) - 1)] == runs if len(codes) else np.zeros(len(runs), bool)


def telling(toxic: list[bytes], ordinary: list[bytes], length: int, parts: int = 4) -> np.ndarray:
    """The runs of ``length`` bytes, sorted, that tell: relatively more of ``toxic`` have them than of ``ordinary``.

    By a likelihood ratio test, one rule whatever the numbers of texts. Counted in ``parts`` by the run's number, to hold fewer at once.
    """
    out = []
    for part in range(parts):
        of = lambda t: (lambda r: np.unique(r[r % np.uint64(parts) == part]))(_runs(t, length))
        codes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(of, toxic)]), return_counts=True)
        codes, n = codes[n > 1], n[n > 1]  # what one text alone has tells nothing
        m = np.zeros(len(codes), np.int64)
        for t in ordinary if len(codes) else ():
            r = of(t)
            at = np.minimum(np.searchsorted(codes, r), len(codes) - 1)
            m[at[codes[at] == r]] += 1
        share = len(toxic) / (len(toxic) + len(ordinary))
        ratio = 2 * (n * np.log(n / (share * (n + m))) + m * np.log(np.maximum(m, 1) / ((1 - share) * (n + m))))
        out.append(codes[(n > share * (n + m)) & (ratio >= LEAST)])
    return np.sort(np.concatenate(out))


def train_dictionaries(toxic: list[str], ordinary: list[str], ordinary_bytes: int, toxic_bytes: int, max_snippets: int = MAX_SNIPPETS) -> tuple[bytes, bytes]:
    """Content of both dictionaries. The toxic one is the ordinary one and up to ``toxic_bytes`` trained on the telling parts of toxic texts.

    The ordinary one is trained on at most ``max_snippets`` snippets of 8 words, drawn from the whole texts.

    Ordinary snippets that hold telling parts aren't trained on, else the ordinary dictionary would hold what they quote.
    """
    import zstandard as z

    def trained(size: int, samples: list[bytes]) -> bytes:
        try:
            return z.train_dictionary(size, samples, d=6, k=24).as_bytes()[-int(size * 0.9) :]
        except z.ZstdError:  # too few samples to choose from: all of them fit
            return b"".join(samples)[-size:]

    joined = lambda words: b" " + b" ".join(words) + b" "
    own, texts = [joined(lower_words(t)) for t in toxic], [lower_words(t) for t in ordinary]
    runs = {n: telling(own, [joined(w) for w in texts], n) for n in RUNS}

    def covered(text: bytes) -> np.ndarray:
        """Which bytes are of telling runs."""
        ends = np.zeros(len(text) + 1, np.int64)
        for n, codes in runs.items():
            at = np.flatnonzero(_among(_runs(text, n), codes))
            ends[at] += 1
            np.subtract.at(ends, at + n, 1)
        return np.cumsum(ends)[:-1] > 0

    kept = []
    for text in own:
        edges = np.flatnonzero(np.diff(covered(text).astype(np.int8), prepend=0, append=0))
        kept.append(b" ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
    samples = []
    for words in texts:
        text, at = joined(words), 0
        told = np.concatenate([[0], np.cumsum(covered(text))])
        for k in range(0, len(words), 8):
            snippet = joined(words[k : k + 8])
            if told[at] == told[at + len(snippet)]:
                samples.append(snippet)
            at += len(snippet) - 1
    random.Random(0).shuffle(samples)
    base = trained(ordinary_bytes, samples[:max_snippets] or [b" "])
    return base, base + trained(toxic_bytes, [k for k in kept if k] or [b" "])


def fit(rows: list[tuple[str, int, bool]], ordinary_bytes: int = 48 * 1024, toxic_bytes: int = 4096, window: int = WINDOW, max_snippets: int = MAX_SNIPPETS) -> ToxicityModel:
    """Train on (text, toxic 0/1, for calibration). Without both labels the model gives the share of toxic rows alone."""
    share = sum(y for _, y, _ in rows) / len(rows) if rows else 0.0
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    flat = ToxicityModel(b" ", b" ", (0.0,) * (len(GAINS) + 3) + (prior,), window)
    train, held = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    if not ({y for _, y, _ in train} >= {0, 1} and {y for _, y, _ in held} >= {0, 1}):
        return flat
    dictionaries = train_dictionaries([t for t, y, _ in train if y], [t for t, y, _ in train if not y], ordinary_bytes, toxic_bytes, max_snippets)
    meter = Meter(*dictionaries, window)
    x, y = _design(np.array([meter.features(t) for t, _, _ in held])), np.array([y for _, y, _ in held], float)
    return ToxicityModel(*dictionaries, tuple(_logistic(x, y)), window)


def drawn_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, may_learn: Column, max_toxic: int, max_ordinary: int, max_bytes: int) -> DataFrame:
    """(t, y, k): at most ``max_toxic`` and ``max_ordinary`` labelled texts of at most ``max_bytes`` each, lowest id hashes k first.

    Of several texts of an id one counts, so these are (max_toxic + max_ordinary) x max_bytes at most.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    once = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & may_learn).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    drawn = [once.filter(F.col("y") == y).orderBy(key, id_col).limit(n) for y, n in ((1, max_toxic), (0, max_ordinary))]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most max_toxic + max_ordinary rows
    held = docs.select(id_col, F.col(text_col).alias("t")).filter(F.octet_length("t") <= max_bytes).join(chosen, id_col)
    return held.groupBy(id_col, "y").agg(F.min("t").alias("t")).select("t", "y", key.alias("k"))


def _distinct_texts(texts: list[tuple[str, int, int]]) -> list[tuple[str, int, bool]]:
    """(text, toxic 0/1, for calibration), equal texts once."""
    return list({t: (t, y, k % 4 == 0) for t, y, k in sorted(texts, key=lambda r: (r[2], r[0]))}.values())


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, may_learn: Column, max_toxic: int, max_ordinary: int, max_bytes: int) -> list[tuple[str, int, bool]]:
    """``drawn_texts`` in the driver, as ``fit`` takes them."""
    return _distinct_texts([tuple(r) for r in drawn_texts(docs, labels, id_col, text_col, label_col, may_learn, max_toxic, max_ordinary, max_bytes).collect()])


def fit_in_task(texts: DataFrame, max_snippets: int = MAX_SNIPPETS) -> ToxicityModel:
    """``fit`` of ``drawn_texts``, a bounded sample, in one task: the driver gets the dictionaries and weights alone, some 100 KB."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(astuple(fit(_distinct_texts(held), max_snippets=max_snippets)))]})

    # a partition without rows may not start a worker
    found = texts.select("t", "y", "k").repartition(1).mapInArrow(lambda b: released(train(b)), "model binary").first()
    return ToxicityModel(*pickle.loads(found["model"])) if found else fit([])


def _judged(batches: Iterator[pa.RecordBatch], model: ToxicityModel, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the scores and the numbers of telling windows of its texts, column ``at``."""
    meter, weights = Meter(model.ordinary, model.toxic, model.window), np.array(model.weights)
    for batch in batches:
        counts = np.array([meter.features(v.as_py()) for v in batch.column(at)]).reshape(-1, len(GAINS) + 1)
        yield batch, 1 / (1 + np.exp(-np.clip(_design(counts) @ weights, -30, 30))), counts[:, 0]


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch, p, found in _judged(batches, model, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(found, pa.int64())], names=["id", "score", "n_windows"])


def _kept(batches: Iterator[pa.RecordBatch], model: ToxicityModel, at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch, p, _ in _judged(batches, model, at):
        yield batch.filter(pa.array(p < least))


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: float = 0.5, folds: int = 5,
    max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_bytes: int = MAX_BYTES, max_snippets: int = MAX_SNIPPETS,
) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more, with all columns; learnt as in ``score_toxicity``. Rows aren't moved."""
    model = fit_in_task(drawn_texts(docs, labels, id_col, text_col, label_col, id_fold(F.col(id_col), folds) != 0, max_toxic, max_ordinary, max_bytes), max_snippets=max_snippets)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: released(_kept(b, model, at, least)), docs.schema)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5,
    max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_bytes: int = MAX_BYTES, max_snippets: int = MAX_SNIPPETS,
) -> DataFrame:
    """Score the whole text of every document: (``id_col``, held_out, score, predicted, n_windows).

    Learns from labelled rows whose crc32(id as text) mod ``folds`` is not 0 alone: a sample bounded by ``max_toxic``,
    ``max_ordinary`` and ``max_bytes``, which one task learns from and the driver never has, of whose whole texts ``max_snippets`` train the
    ordinary dictionary. Null and empty texts have no windows and get the curve's value there. Null ids score as others (never
    held out); repeated rows score alike; of several labels of an id the highest counts. Without labels every score is the share
    of toxic labels, or 0. Other columns are not read.
    """
    model = fit_in_task(drawn_texts(docs, labels, id_col, text_col, label_col, id_fold(F.col(id_col), folds) != 0, max_toxic, max_ordinary, max_bytes), max_snippets=max_snippets)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: released(_score(b, model)), f"id {kind}, score double, n_windows long")
    held_out = F.coalesce(id_fold(F.col("id"), folds) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")
