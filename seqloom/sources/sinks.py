"""Outputs of the pipeline stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# value types of literals in the triple export
XSD = {"string": "string", "integer": "integer", "float": "float"}


def write_segments(segments: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Segments as parquet, in one folder per method and parameter set if those are given."""
    writer = segments.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pattern maps, resampled search models and known series."""
    df.write.mode(mode).parquet(path)


def write_bricks(bricks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    bricks.write.mode(mode).json(path)


def ntriples(triples: DataFrame) -> DataFrame:
    """``(s, p, o, dtype)`` rows as N-Triples lines."""
    def uri(c):
        for x in "%\t\n\r <>\"{}|^`\\":  # the sign of the escapes first; each character has its own
            c = F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}"))
        return F.concat(F.lit("<"), c, F.lit(">"))

    escaped = F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                        F.lit("\n"), F.lit("\\n"))
    escaped = F.replace(escaped, F.lit("\r"), F.lit("\\r"))
    is_uri = (F.col("dtype") == "uri") & F.col("o").startswith("urn:")
    typed = F.concat(F.lit('"'), escaped, F.lit('"^^<http://www.w3.org/2001/XMLSchema#'),
                     F.when(F.col("dtype") == "uri", F.lit("string")).otherwise(F.col("dtype")), F.lit(">"))
    classes = F.concat(F.lit("<urn:seqloom:class/"), F.col("o"), F.lit(">"))
    kind = (F.col("dtype") == "uri") & (F.col("p") == "type")
    obj = F.when(kind, classes).when(is_uri, uri(F.col("o"))).otherwise(typed)
    predicate = F.when(F.col("p") == "type", F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>")).when(
        F.col("p") == "label", F.lit("<http://www.w3.org/2000/01/rdf-schema#label>")).otherwise(
        F.concat(F.lit("<urn:seqloom:"), F.col("p"), F.lit(">")))
    return triples.select(F.concat_ws(" ", uri(F.col("s")), predicate, obj, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    ntriples(triples).write.mode(mode).text(path)
