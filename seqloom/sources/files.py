"""Further inputs: metadata, selections, grammars, edge lists, known sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# positional columns of the header-less metadata file; the unnamed ones are not used
METADATA_COLUMNS = ("track", "title", "artist", "_3", "_4", "_5", "_6", "genre")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in METADATA_COLUMNS)
    df = spark.read.schema(schema).option("header", False).csv(path)
    return df.select("track", "title", "artist", "genre")


def with_metadata(tracks: DataFrame, metadata: DataFrame, strict: bool = False) -> DataFrame:
    """Attach metadata; with ``strict`` a track without any raises when the row is computed."""
    out = tracks.join(metadata.withColumn("_found", F.lit(True)), "track", "left")
    if strict:
        message = F.concat(F.lit("no metadata for "), F.col("track").cast("string"))
        out = out.withColumn("_found", F.when(F.col("_found").isNull(), F.raise_error(message)).otherwise(True))
        return out.filter("_found").drop("_found")
    return out.drop("_found")


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated blocks, one per row, ready for ``parse_grammar``."""
    return spark.read.option("lineSep", "\n\n").text(path)


def read_bricks(spark: SparkSession, path: str) -> DataFrame:
    from seqloom.operators.patterns import COMPONENT
    schema = ("name string, variant string, mode string, block_type string, block_key string, "
              f"components array<{COMPONENT}>")
    return spark.read.schema(schema).json(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges by the names in the header; further columns are left out."""
    kinds = {"source": "bigint", "target": "bigint", "distance": "double", "type": "string"}
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, stem and size of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
                        F.col("length").alias("n_bytes"))
