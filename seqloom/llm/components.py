"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): returns (v, root) for every linked value, root being the smallest one reachable.

    Rounds of minimum labels with pointer jumping, each written to the shared folder. An empty table of
    links gives an empty result.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "v"), "roots")
    while True:
        near = (both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("root").alias("near")))
        step = stored(labels.join(near, labels["v"] == near["a"])
                      .select("v", F.col("root").alias("old"), F.least("root", "near").alias("root")), "roots")
        up = step.select(F.col("v").alias("u"), F.col("root").alias("above"))
        labels = stored(step.join(up, step["root"] == up["u"])
                        .select("v", F.col("above").alias("root"), (F.col("above") != F.col("old")).alias("moved")),
                        "roots")
        if labels.where("moved").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")
