"""The queries op1 to op13 and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, length=2048)


def op2_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.media import encode_texts, features

    return features(encode_texts(_table(spark, sf_dir, "documents")), "doc_id", "media")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


#: All pairs that share a shingle, counted; components by the smallest label reached.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(min(r.seen) AS BIGINT) AS component_id
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.sharding import kd_shards

    return kd_shards(_table(spark, sf_dir, "documents"), shards=8)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.secretscan import secret_spans

    return secret_spans(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.chat import chat_digests, with_control_case

    return chat_digests(with_control_case(_table(spark, sf_dir, "conversations")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.licenses import license_digests

    return license_digests(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aeroframe.llm.storage import Scratch
    from aeroframe.llm.tokenfile import read_token_files, write_token_files

    uri = Scratch(spark, "op9").uri
    write_token_files(_table(spark, sf_dir, "documents"), uri, _vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, uri)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_jpeg_media, op3_jaccard_join, op4_kd_sharding, op5_language_id, op6_secret_scan, op7_embedding_near_dedup, op8_chat_format, op9_token_files, op10_mixing, op11_prefix_trie, op12_collocations, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    from aeroframe.llm.chat import OP8_SQL
    from aeroframe.llm.collocations import OP12_SQL
    from aeroframe.llm.mixing import OP10_SQL
    from aeroframe.llm.neardup import OP7_SQL
    from aeroframe.llm.trie import OP11_SQL

    return {"op3_jaccard_join": OP3_SQL, "op7_embedding_near_dedup": OP7_SQL, "op8_chat_format": OP8_SQL, "op10_mixing": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL}
