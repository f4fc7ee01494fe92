"""Connected components of large graphs whose links come from shared keys.

Rows that share a key are linked to the smallest row of that key, so a key with n rows gives n - 1
links, not n^2 pairs. The components follow from alternating large-star and small-star steps, which
shrink long chains in a number of rounds that grows with the logarithm of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import session

#: A key is hot if it holds more than this share of all keyed rows; there are fewer than 1 / share of them.
HOT_SHARE = 0.001
SALTS = 64


def star_links(df: DataFrame, node: str, key: Column) -> DataFrame:
    """(u, v): each row of a key and the smallest row of it, for keys with two rows or more.

    The minimum is combined before the shuffle. Rows of hot keys are spread over salts for the join
    back; the list of hot keys is bounded by 1 / HOT_SHARE and so may be broadcast.
    """
    keyed = df.select(F.col(node).alias("u"), key.alias("k")).filter(F.col("k").isNotNull() & F.col("u").isNotNull())
    least = keyed.groupBy("k").agg(F.min("u").alias("v"), F.max("u").alias("last"), F.count("*").alias("n")).filter("v < last")
    total = keyed.agg(F.count("*").alias("total"))
    hot = least.join(F.broadcast(total), F.col("n") > HOT_SHARE * F.col("total")).filter("n > 10000").select("k", F.lit(True).alias("hot"))
    left = keyed.join(F.broadcast(hot), "k", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("u"), F.lit(SALTS))).otherwise(0).cast("int"))
    right = least.join(F.broadcast(hot), "k", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.select("k", "salt", "v"), ["k", "salt"]).filter("u <> v").select("u", "v")


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link to another.

    ``links`` has columns u and v of one comparable type; direction, repeats, loops and nulls don't
    matter. Every round is written to the shared checkpoint folder. An empty table gives an empty
    result. Raises RuntimeError if ``max_rounds`` don't suffice.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = session.cut(edges), None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u hang below the smallest of u and its neighbours.
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below hang below the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = session.cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(state)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
