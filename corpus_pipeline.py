"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of documents. Between stages the documents are written to the shared folder
and read again, so that a lost executor costs no stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, lines, mix, quality, simhash
from tabulon.llm.common import documents, keep, labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those that are labelled and not held out.

    Null and empty texts are scored like any other; where labels lack a class all documents score 0.5 and stay; rows repeated in
    full have one score and stay or go together; a null id counts as an empty one; no documents give none; other columns go."""
    return quality.keep_good(docs.select(*COLUMNS), labels(spark, sf_dir))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of similar lines keeps its first line; documents stay, with what is left of them.

    Null and empty texts stay as they are; a text may become empty; rows repeated in full are one document, whose lines stay or go
    in each of them; of lines in documents with one id, those of the lesser hash of the text come first; n_chars is counted anew
    where lines went; no documents give none; other columns go."""
    done = lines.dedup_lines(docs.select(*COLUMNS), every=True)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null and empty texts are near duplicates of each other; a document without an id gives way to those with one; of documents
    with one id the text with the lesser hash stays, and rows repeated in full are one; no documents give none; other columns go."""
    return simhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Documents without words (null, blank) take nothing and go; a null source is a source of its own; rows repeated in full count
    each in the mix, which takes them together as often as it takes each of them in sum; no documents give none; other columns
    go."""
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text", "lang", "source", "n_chars")), F.hex(F.xxhash64(F.lit(1), "text")))
    named = docs.select(*COLUMNS, name.alias("__row"))
    taken = mix.mix(named, mix.word_count(F.col("text")), key="__row").groupBy("__row").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    found = named.join(taken.where("copies > 0"), "__row")
    each = found.where("rows = 1").union(found.where("rows > 1").dropDuplicates(["__row"]))
    return each.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of the text that they decode to.

    Null and empty texts have no tokens; rows repeated in full give a row each; no documents give none; other columns go."""
    return bpe.encode_table(docs, bpe.vocabulary_path(), full=True).drop("decoded")


STAGES = [("quality", good), ("lines", without_repeated_lines), ("simhash", without_near_duplicates), ("mix", mixed), ("bpe", encoded)]

#: Fuzzy lines, components and byte-pair encoding are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE_SQLS = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
