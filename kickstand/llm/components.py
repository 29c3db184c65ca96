"""Connected components of a graph given as links, by contraction to stars; nothing is gathered on the driver."""

from pyspark.sql import functions as F

from kickstand.llm import common


def components(links, name="components"):
    """node, root for every node that has a smaller node in its component; root is the smallest.

    links: a, b with a < b. A round points every node to its smallest neighbour, links that neighbour's rivals to
    it, and then points past neighbours that point on themselves. Rounds are logarithmic in the longest path; each
    is stored, so a lost executor leads back to the last round. Sums of tasks meet in every aggregate and joins
    are plain equi-joins, so a hub of many links is not one task's work.
    """
    links = common.written(links.select("a", "b").distinct(), name)
    while True:
        nearest = links.groupBy("b").agg(F.min("a").alias("p"))
        held = links.join(nearest, "b")
        met = held.select("p", "b").union(held.where(F.col("p") < F.col("a")).select("p", F.col("a").alias("b"))).distinct()
        up = met.groupBy("b").agg(F.min("p").alias("q")).withColumnRenamed("b", "at")
        moved = met.join(up, met["p"] == up["at"], "left").select(F.coalesce("q", "p").alias("a"), "b").distinct()
        after = common.written(moved, name)
        # a star forest: every node has one link, and no centre is itself a leaf
        many = after.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        chained = after.join(after.select(F.col("b").alias("a")), "a", "left_semi")
        links = after
        if many.isEmpty() and chained.isEmpty():
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
