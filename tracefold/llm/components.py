"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations and joins over the edge table; hot nodes are
pre-aggregated before the shuffle and joined with skew handling. Lineage is cut
by writing each step's edges to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import materialise, release


#: A key with more rows than this, or than one in 100,000 of them, is hot; so at most 100,000 keys are.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join with ``groups``, which has one row a key, without gathering the rows of a hot key.

    The groups of hot keys, at most ``HOT_KEYS``, are broadcast; the other rows are shuffled.
    Both sides are read several times: give tables, not long plans. Null keys match nothing.
    """
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    keys = rows.groupBy(key).count().where(F.col("count") > most).select(F.col(key).alias("hot_key"))
    if keys.isEmpty():
        return rows.join(groups, key, "left")
    is_hot = F.col(key).eqNullSafe(F.col("hot_key"))
    hot = groups.join(F.broadcast(keys), is_hot, "left_semi")
    return (
        rows.join(F.broadcast(keys), is_hot, "left_semi").join(F.broadcast(hot), key, "left")
        .unionByName(rows.join(F.broadcast(keys), is_hot, "left_anti").join(groups, key, "left"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) of every node with an edge, and the table's path.

    edges: u, v of one orderable type; loops and repeats are allowed. component
    is the smallest node reached. No edges give an empty table.
    """
    now, path = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        new, new_path = materialise(_small_star(_large_star(now)), "edges")
        a, b = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, new))
        release(now.sparkSession, path)
        now, path = new, new_path
        if a == b:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    release(now.sparkSession, path)
    return out
