"""A corpus in five stages: language, near duplicates, secrets, mixing, packing.

Each stage takes all documents that its predecessor kept and returns documents
(the last one: packed pieces). ``run`` writes every stage to the shared folder
and reads it again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.llm.jaccard import jaccard_components
from aeroframe.llm.langid import fit, predict
from aeroframe.llm.mixing import resample
from aeroframe.llm.packing import pack
from aeroframe.llm.secretscan import redact_documents
from aeroframe.llm.storage import Scratch

#: Documents whose best language scores less are rejected: every language's output is then below -0.5.
LEAST_SCORE = 0.25
#: So are those of which the landmarks know less than this share of the n-grams. On sf0.1 and check_s every
#: document in a learned language has 0.55 or more, texts in other scripts have 0.12 or less.
LEAST_KNOWN = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; those without letters, without any likely language or strange to all landmarks go.

    Null and empty texts have no letter and go; very long texts are read whole;
    repeated rows, and rows that tie in their text, share one decision; without
    a labelled row, or in an empty table, nothing stays. Columns stay as they
    are; the decision's own have names that no table has.
    """
    added, known = ("__language", "__language_score"), "__language_known"
    named = predict(docs, fit(docs), added=added, keep=tuple(docs.columns), share=known)
    return named.where((F.col(added[0]) != "und") & (F.col(added[1]) >= LEAST_SCORE) & (F.col(known) >= LEAST_KNOWN)).drop(*added, known)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of 5-word shingle sets linked at a Jaccard similarity of 0.8 stays: that of the smallest id.

    Rows without an id, and all but one of the rows of one id, get keys above
    all ids: each is compared by its own text, and stays where no row of a
    smaller key is in its group. Null and empty texts, and those without a word,
    link with nothing and stay; very long texts are compared whole; an empty
    table gives none. Columns stay as they are.
    """
    key, place, head = "__key", "__place", "__head"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    scratch = Scratch(spark, "near-duplicates")
    several = scratch.save(ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(key)), "several")
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))
    if not several.isEmpty():
        above = (ids.agg(F.max("doc_id")).first()[0] or 0) + 1
        doubtful = rows.where(F.col(key).isNull()).unionByName(rows.join(several, key, "left_semi"))
        doubtful = scratch.save(doubtful.withColumn(place, F.monotonically_increasing_id()), "doubtful")
        heads = doubtful.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias(place)).select(place, F.lit(True).alias(head))
        told = doubtful.join(heads, place, "left").withColumn(key, F.when(F.col(head), F.col(key)).otherwise(F.col(place) + above)).drop(place, head)
        rows = scratch.save(rows.where(F.col(key).isNotNull()).join(several, key, "left_anti").unionByName(told), "rows")
    groups = jaccard_components(rows, k=5, num=80, den=100, id_col=key)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and so do null, empty and very long texts, repeated rows and further columns.

    ``n_chars``, where it is there, follows the text, and stays where that is null.
    """
    clean = redact_documents(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, once or repeated, with all their columns.

    Null and empty texts have no words, cost nothing and come as often as whole
    copies of their source do; a null source is one of its own; a very long text
    counts with all its words; repeated rows are drawn one by one, ties by their
    numbers; an empty table gives none.
    """
    return resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: every row gives one at least, null and empty texts that of the end alone, very long ones many; an empty table none."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("packed", packed)]

#: The first stage learns a model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
