"""Connected components of a table of links, by rounds of contraction.

In each round every node points to the neighbour (or itself) with the smallest hash of that round; links
are then drawn between the targets. Hashes make the pointers random, so a long chain shrinks by a constant
factor in each round as well. Each round's tables are written to the shared folder; nothing reaches the
driver but whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import written


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): one row per node with a link; nodes have the same root if a path joins them.

    Links to itself, repeated links and links with a null end count for nothing.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        seed = len(rounds)
        rank = f"struct(xxhash64({{0}}, {seed}) AS h, {{0}} AS node)"
        target = both.groupBy("u").agg(F.expr(f"min({rank.format('v')})").alias("best"))
        target = written(target.select("u", F.expr(f"least(best, {rank.format('u')}).node").alias("p")), "targets")
        rounds.append(target)
        left = both.join(target, "u").select(F.col("p").alias("pu"), "v")
        right = left.join(target.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        both = written(right.select(F.col("pu").alias("u"), F.col("pv").alias("v")).filter("u <> v").distinct(), "links")
    if not rounds:
        return one.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rounds[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for target in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("p"), "root")
        roots = target.join(later, "p", "left").select(F.col("u").alias("node"), F.expr("coalesce(root, p)").alias("root"))
    return roots
