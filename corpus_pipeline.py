"""A corpus pipeline of five stages; each reads the Parquet table that the one before has written.

What stages do with unusual rows: documents without any letter (null and empty texts among them) go in the first stage, where nothing
else goes. A document without an id is told apart by its text: of equal texts without ids one stays, and none if a document
with an id has that text; rows that repeat an id and a text are one document. Of a class of near copies the document with the
smallest id stays. Very long texts are read whole by every stage. Extra columns are carried along whatever their names (the
last stage replaces columns named like its own three). An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import read, ship, stash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text; those without any letter go.

    Where no language can be learned (no usable label), all documents with a letter stay.
    """
    from riskloom.llm.langid import UNKNOWN, learn, predict

    ship(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = learn(docs.select("doc_id", "text", "lang"), ~held_out)
    if not model.samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return predict(docs, model).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``: the id where it tells a text, and a number from the text where the id is null or has several.

    These numbers are larger than any id below 2^62, so that rows with an id come first. Rows share a number if
    they have the same id and text, or the same text and no id of their own.
    """
    forms = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__odd")).agg(F.min(F.xxhash64("text")).alias("__least"), F.max(F.xxhash64("text")).alias("__most"))
    odd = stash(forms.where("__least <> __most").select("__odd", "__least"), "odd-ids")
    of_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    if odd.isEmpty():
        return docs.withColumn("__row", F.coalesce(F.col("doc_id"), of_text))
    other = F.col("doc_id").isNull() | (F.col("__least").isNotNull() & (F.col("__least") != F.xxhash64("text")))
    return docs.join(odd, F.col("doc_id") == F.col("__odd"), "left").select(*docs.columns, F.when(other, of_text).otherwise(F.col("doc_id")).alias("__row"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near and exact copies one document: that with the smallest id, if any has one.

    Copies may repeat an id or have none. Texts without words have no copies and stay.
    """
    from riskloom.llm.jaccard import jaccard_classes

    ship(spark)
    rows = _numbered(docs)
    # one row of this a row of docs, of three numbers
    classes = stash(jaccard_classes(rows, id_col="__row"), "classes")
    copies = stash(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__copy")).distinct(), "copies")
    again = stash(classes.where("doc_id = component_id and n_shingles > 0").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again"), "repeated")
    kept = rows.join(copies, F.col("__row") == F.col("__copy"), "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, F.col("__row") == F.col("__again"), "left_anti")
    rest = [c for c in docs.columns if c != "text"]
    first = kept.join(again, F.col("__row") == F.col("__again"), "left_semi").groupBy("__row", "text").agg(F.min(F.struct(*rest)).alias("__first"))
    return once.select(*docs.columns).unionByName(first.select("text", "__first.*").select(*docs.columns))


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from riskloom.llm.decontam import drop_leaks

    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    from riskloom.llm.mixing import mix

    ship(spark)
    return mix(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    from riskloom.llm.sharding import shard

    return shard(docs, payload=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", remove_near_copies),
    ("decontamination", remove_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: Learned and seeded stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
