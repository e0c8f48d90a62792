"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.storage import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; links are (a, b), in either direction, with any repeats.

    Alternating large-star and small-star rounds; each needs a minimum for each node, which is
    aggregated before it is shuffled, and joins that Spark can split where a node has many links.
    A round's result is written to the shared folder, and the round before it is deleted. Rounds go on until
    one changes nothing: a logarithm of the links, squared, at most.
    """
    spark = links.sparkSession
    now, path = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after, new_path = materialise(small)
        sign = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(spark, path)
        now, path = after, new_path
        if sign == before:
            break
        before = sign
    # at the end every link leads from a node to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
