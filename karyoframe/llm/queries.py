"""The queries of this subpackage: thin digests over the operators, on whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import media_digests
from .common import table
from .jaccard import jaccard_components
from .packing import sequence_digests
from .piece_codec import digest_texts
from .pii import with_surrogates
from .quality import judge
from .secrets import secret_digests
from .sharding import shard_rows
from .token_counts import count_tokens
from .token_files import token_file_digests


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 40)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_entities"), "text")


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {f.__name__: f for f in (op1_piece_codec, op2_secret_scan, op3_best_fit_packing, op4_token_counts, op5_ngram_jaccard, op6_stratified_shards, op7_quality_rules, op8_pii_surrogates, op9_mpeg_audio, op10_token_files)}

_OP5 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s), g AS MATERIALIZED (SELECT doc_id, unnest(sh) AS gram FROM s),
c AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS MATERIALIZED (SELECT i, j FROM c JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * common >= 85 * (a.n + b.n - common)),
e AS MATERIALIZED (SELECT i, j FROM l UNION ALL SELECT j, i FROM l), r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.j), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.i = n.doc_id GROUP BY n.doc_id, n.n"""

#: SQL for what SQL can express at this size; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op5_ngram_jaccard": _OP5}
