"""From raw documents to packed training sequences: rejects, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the
documents of the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import mixing, near_text, packing, quality
from seqloom.llm.common import stored, words
from seqloom.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more), learned from all labels."""
    docs = docs.select(*COLUMNS)
    space = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, space).where(F.col("_score") >= 0.5).select(*COLUMNS)


def _only(docs: DataFrame, several: DataFrame, keys: list) -> DataFrame:
    """``docs`` without repetitions of the rows whose ``keys`` are in ``several``; only these are shuffled."""
    match = [docs[k].eqNullSafe(several[k]) for k in keys]
    once = docs.join(several, match, "left_semi").dropDuplicates(keys)
    return docs.join(several, match, "left_anti").unionByName(once)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, rows without one last.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. It is decided by
    row: rows of one doc_id with texts of their own stay, copies without a doc_id go as others do. Between rows of a
    group that share the doc_id the hash of all columns decides; of rows equal in all columns one stays.
    """
    docs = docs.select(*COLUMNS).withColumn("h", F.xxhash64(*COLUMNS))
    groups = near_text.class_components(docs)
    slim = stored(docs.select("doc_id", "h", near_text.text_class(F.col("text")).alias("v")).join(groups, "v"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = slim.groupBy("component").agg(F.min(order).alias("first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    gone = slim.join(first, "component").where(~is_first).select("doc_id", "h").distinct()
    several = slim.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    kept = docs.join(gone, [docs["h"] == gone["h"], docs["doc_id"].eqNullSafe(gone["doc_id"])], "left_anti")
    return _only(kept, stored(several, "repeated"), ["h", "doc_id"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: one row per document and round, cut to the words taken.

    A document taken whole keeps its text; of one taken in part, the words taken are joined by a space. Rows
    equal in all columns are taken each; a document that the mix does not take has no row.
    """
    docs = docs.select(*COLUMNS)
    held, taken = mixing.mix(docs, identity=COLUMNS)
    runs = taken.groupBy("source", "cell", "row_no", "round").agg(
        F.sort_array(F.collect_list(F.struct("doc_start", "length"))).alias("runs"), F.sum("length").alias("taken"))
    named = held.join(runs, mixing.same_row(held, runs)).select(
        held["row_hash"].alias("h"), held["doc_id"].alias("id"), held["size"], "runs", "taken")
    # equal rows come back from `named`, so that they are joined once; the id tells rows apart whose hashes agree
    several = held.groupBy(F.col("row_hash").alias("h"), "doc_id").count().where("count > 1").select("h", "doc_id")
    once = _only(docs.withColumn("h", F.xxhash64(*COLUMNS)), stored(several, "repeated"), ["h", "doc_id"])
    # a lambda variable holds the words: as a column they would be found anew for every run
    taken_words = lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(
        w, (r["doc_start"] + 1).cast("int"), r["length"].cast("int")))), " ")
    part = F.get(F.transform(F.array(words(F.col("text"))), taken_words), F.lit(0))
    return (once.join(named, (once["h"] == named["h"]) & once["doc_id"].eqNullSafe(named["id"]))
            .withColumn("text", F.when(F.col("taken") < F.col("size"), part).otherwise(F.col("text")))
            .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packing.op6_pack_differencing(spark, docs)


STAGES = [("quality classifier", keep_quality), ("near-dedup", drop_near_duplicates),
          ("mixing sources", mix_sources), ("packing", pack_sequences)]

#: Hash fingerprints, votes and tokenizers have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
