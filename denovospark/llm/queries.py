"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_tree import digest_bpe
from .chat import link_calls, turns_as_calls
from .common import table
from .decontamination import find_leaks
from .fill_in_middle import fill_in_middle, restored
from .lm_scoring import score_documents
from .ngram_join import ngram_components
from .packing import pack_texts
from .pii import pseudonymise
from .quality_rules import apply_quality_rules
from .sharding import shard_documents
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op8_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The key where the session's configuration has none (spark.denovospark.pseudonym.key): for tests alone, as anybody can read it here.
KEY = "documents-2024"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.denovospark.pseudonym.key", KEY)


@query
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark), count_col="n_replaced")


@query
def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*turns_as_calls(table(spark, sf_dir, "conversations")))


ORACLE_SQL["op9_tool_calls"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text, role, CASE WHEN role = 'user' THEN 'reply' ELSE role END AS name, nullif(regexp_extract(coalesce(text, ''), '[0-9][0-9.,:/-]*'), '') AS c FROM conversations),
     asks AS (SELECT *, name IN ('reply', 'system') AND (c IS NULL OR regexp_full_match(c, '0|[1-9][0-9]*')) AS good,
                     row_number() OVER (PARTITION BY conv_id, turn ORDER BY name NULLS FIRST, c IS NULL, c, length(text)::VARCHAR, text) AS k FROM t WHERE role IS NULL OR role <> 'assistant'),
     answers AS (SELECT conv_id, turn, text FROM t WHERE role = 'assistant'),
     firsts AS (SELECT conv_id, turn FROM asks WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
     d AS (SELECT conv_id, turn, 0 AS depth FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM firsts g WHERE g.conv_id = f.conv_id AND g.turn = f.turn - 2)
           UNION ALL SELECT f.conv_id, f.turn, d.depth + 1 FROM d JOIN firsts f ON f.conv_id = d.conv_id AND f.turn = d.turn + 2)
SELECT a.conv_id, coalesce(d.depth, 0) AS depth, a.turn AS step, 0 AS part, a.turn, a.turn::VARCHAR AS call_id,
       CASE WHEN d.turn IS NOT NULL AND k > 1 THEN 'repeated' WHEN name IS NULL OR name NOT IN ('reply', 'system') THEN 'unknown tool' WHEN NOT good THEN 'ill-typed argument'
            WHEN EXISTS (SELECT 1 FROM answers b WHERE b.conv_id = a.conv_id AND b.turn - 1 = a.turn) THEN 'ok' ELSE 'no result' END AS status,
       '{"arguments":{' || coalesce('"count":' || CASE WHEN good THEN c ELSE '"' || c || '"' END || ',', '') || '"length":' || CASE WHEN good THEN length(text)::VARCHAR ELSE '"' || length(text) || '"' END
         || ',"prompt":' || to_json(text) || '},"id":"' || a.turn || '"' || coalesce(',"name":' || to_json(name), '') || ',"role":"assistant"}' AS json
FROM asks a LEFT JOIN d ON d.conv_id = a.conv_id AND d.turn = a.turn
UNION ALL
SELECT b.conv_id, coalesce(d.depth, 0), coalesce(d.turn, b.turn), 1, b.turn, (b.turn - 1)::VARCHAR, CASE WHEN d.turn IS NULL THEN 'orphan' ELSE 'ok' END,
       '{"content":' || to_json(b.text) || ',"id":"' || (b.turn - 1) || '","role":"tool"}'
FROM answers b LEFT JOIN d ON d.conv_id = b.conv_id AND d.turn = b.turn - 1
"""


ORACLE_SQL["op8_ngram_components"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT sides.b, reached.root FROM reached JOIN sides ON sides.a = reached.doc_id)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(root) AS component_id FROM s JOIN reached ON reached.doc_id = s.doc_id GROUP BY 1
"""


@query
def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "c"), "identity_error")
    return each.select("vec_id", (F.col("component") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""


@query
def op13_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
