"""Operator 7: quality rules whose thresholds are controlled for risk.

A rule rejects a document whose statistic is at or above its cutoff. The rules' cutoffs move together along LEVELS levels, from
the loosest to the strictest, so that what a level rejects, all stricter ones reject too. For every stratum (language) the labelled
good documents are the holdout; nothing is learnt from labels, so all of them serve. The levels are tested in their order: one is
certified if the exact binomial upper bound (Clopper-Pearson) on its false rejections is at most ``alpha``, and the first that
isn't ends the sequence. A fixed sequence needs no correction for the number of levels; for the strata ``delta`` is divided by
their number (Bonferroni). Hence, with probability 1 - delta, no stratum loses more than ``alpha`` of the good documents that the
base rules leave. Of the certified levels the one that rejects most of the labelled bad documents is used, on ties the loosest;
where none is certified, the rules are off.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

_WORDS = re.compile(WORD)
_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_capitals")
#: Strata up to which their levels are broadcast.
BROADCAST_STRATA = 100_000


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics in STATS of one whole text; null has none of anything."""
    if not text:
        return (0,) * len(STATS)
    words = _WORDS.findall(text)
    n, repeated = len(words), 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0  # first word that no earlier repeated window has covered
        for k, window in enumerate(windows):
            if counts[window] > 1:
                repeated += k + 3 - max(k, end)
                end = k + 3
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return (
        n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), text.count("!"), len(_CAPITAL.findall(text)),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_stats(v.as_py()) for v in batch.column(3)]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "stratum", "digest", *STATS])


@dataclass(frozen=True)
class Rule:
    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]

    def value(self) -> Column:
        return F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1))


LEVELS = 10
#: From the loosest to the strictest level.
RULES = (
    Rule("symbols", "n_symbols", "n_words", (1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05)),
    Rule("exclaims", "n_exclaims", "n_words", (1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05)),
    Rule("capitals", "n_capitals", "word_chars", (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("repeats", "n_repeat_words", "n_words", (0.5, 0.47, 0.44, 0.41, 0.38, 0.35, 0.32, 0.29, 0.26, 0.2)),
    Rule("long_words", "word_chars", "n_words", (30.0, 26.0, 23.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
)


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact upper bound at confidence 1 - delta on a rate of which k of n draws are seen: the p with P(X <= k) = delta."""
    if k >= n:
        return 1.0

    def log_cdf(p: float) -> float:
        """P(X <= k) for p >= k / n: its terms fall from the k-th down, and stop to count after some square roots of n."""
        first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        total, term, i = 1.0, 1.0, k
        while i > 0 and term > 1e-18 * total:
            term *= i * (1 - p) / ((n - i + 1) * p)
            total, i = total + term, i - 1
        return first + math.log(total)

    low, high, goal = k / n, 1 - 1e-12, math.log(delta)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid > 0 and log_cdf(mid) > goal else (low, mid)
    return high


def certified(good: list[int], bad: list[int], alpha: float, delta: float) -> int:
    """The level to use, 0 for none. good[k], bad[k]: labelled documents that levels from k on reject, at 0 those that none does."""
    n, lost, caught, best, choice = sum(good), 0, 0, 0, 0
    for level in range(1, len(good)):
        lost, caught = lost + good[level], caught + bad[level]
        if n == 0 or binomial_upper(lost, n, delta) > alpha:
            break
        if caught > best:
            best, choice = caught, level
    return choice


def _first_level() -> Column:
    """The loosest level that rejects a document, 0 if none does."""
    exceeded = F.greatest(*(sum((r.value() >= c).cast("int") for c in r.cutoffs) for r in RULES))
    return F.when(exceeded > 0, LEVELS + 1 - exceeded).otherwise(0)


def _choose(batches: Iterator[pa.RecordBatch], alpha: float, delta: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels = [certified(g, b, alpha, delta) for g, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32())], names=["of", "level"])


def levels_of(stats: DataFrame, labels: DataFrame, id_col: str, good: Column, alpha: float, delta: float) -> DataFrame:
    """(of, level): the certified level of each labelled stratum, 0 for none. The draws are distinct texts of distinct ids."""
    of_id = labels.groupBy(id_col).agg(F.min(good.cast("int")).alias("good")).filter("good is not null")
    held = stats.filter(~F.col("base_failed")).join(of_id, id_col)
    by_id = held.groupBy(id_col).agg(F.min(F.struct("digest", "stratum", "good", "first_level")).alias("one")).select("one.*")
    held = by_id.groupBy("stratum", "digest").agg(F.min("good").alias("good"), F.min("first_level").alias("first_level"))
    count = lambda good, k: F.count(F.when((F.col("good") == good) & (F.col("first_level") == k), 1))
    counts = held.groupBy("stratum").agg(*(F.array(*(count(g, k) for k in range(LEVELS + 1))).alias(name) for g, name in ((1, "good"), (0, "bad"))))
    counts = materialize(counts, "quality-counts")
    share = delta / max(counts.count(), 1)
    kind = stats.schema["stratum"].dataType.simpleString()
    return materialize(counts.mapInArrow(lambda b: _choose(b, alpha, share), f"of {kind}, level int"), "quality-levels")


def apply_quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality",
    alpha: float = 0.03, delta: float = 0.05,
) -> DataFrame:
    """Statistics, base verdict and verdict of the certified rules for every document.

    Returns (``id_col``, the STATS, base_failed, kept, stratum, level, one ``by_<rule>`` boolean each). The texts are read once and
    not shuffled; the statistics are written to the shared folder. A null or empty text has no words and fails the base.
    A null language is a stratum of its own. Repeated ids are kept as they are; in the holdout an id counts
    once (by its text of least digest), and a text once in a stratum, as bad if any label is. Labels that are null don't count. In strata without labels no level is certified. Other columns are not read.
    """
    kind, of = docs.schema[id_col].dataType.simpleString(), docs.schema[stratum_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.md5(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    stats = source.mapInArrow(_stats, f"id {kind}, stratum {of}, digest string, " + ", ".join(f"{s} long" for s in STATS)).withColumnRenamed("id", id_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(stats.withColumns({"base_failed": failed, "first_level": _first_level()}), "quality-stats")
    levels = levels_of(stats, labels, id_col, F.col(good_col) == 1, alpha, delta)
    small = levels.count() <= BROADCAST_STRATA
    judged = stats.join(F.broadcast(levels) if small else levels, F.col("stratum").eqNullSafe(F.col("of")), "left")
    level = F.coalesce("level", F.lit(0))
    by = {r.name: F.coalesce(r.value() >= F.element_at(F.array(*map(F.lit, r.cutoffs)), F.when(level > 0, level)), F.lit(False)) for r in RULES}
    rejected = (F.col("first_level") > 0) & (F.col("first_level") <= level)
    return judged.select(id_col, *STATS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "stratum", level.alias("level"), *(c.alias(f"by_{n}") for n, c in by.items()))
