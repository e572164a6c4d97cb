"""Which points lie in which ranges, at the cost of the matches: no point is compared with a range that it does not lie in.

Points and the ends of ranges are put in one order, by group and key, in range partitions: a group of any size is spread over as many as its rows
fill. Counting the points before each row, within a partition and before it, gives each point its rank and each range the ranks it spans;
a range's ranks are then joined with the points' by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import buckets, written

C = F.col
FROM, TO = "from", "to"
ORDER = ("group", "zone", "key", "kind", "item")


def bound(side: str, key: Column, after: bool) -> Column:
    """An end of a range: FROM or TO, its key, and whether it stands after the points with this key."""
    return F.struct(F.lit(side).alias("side"), key.alias("key"), F.lit(after).alias("after"))


def at_least(key: Column) -> Column:
    return bound(FROM, key, False)


def above(key: Column) -> Column:
    return bound(FROM, key, True)


def at_most(key: Column) -> Column:
    return bound(TO, key, True)


def below(key: Column) -> Column:
    return bound(TO, key, False)


def matches(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """range and item of each match, once for each point. points: group, key, item; ranges: range (a key of the range), group and bounds (array of
    `bound`, all of which must hold; without any all points of the group match)."""
    none = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
    at = lambda n: F.lit(n).alias("zone")
    given = ranges.select("range", "group", F.explode("bounds").alias("b")).select("range", "group", "b.*")
    ends = given.select("group", at(1), "key", F.when(C("after"), 2).otherwise(0).alias("kind"), none("item", points), "range", "side")
    for side, zone in ((FROM, 0), (TO, 2)):  # the group's own ends hold for every range
        ends = ends.unionByName(ranges.select("group", at(zone), none("key", points), F.lit(0).alias("kind"), none("item", points), "range", F.lit(side).alias("side")))
    rows = points.select("group", at(1), "key", F.lit(1).alias("kind"), "item", none("range", ranges), F.lit(None).cast("string").alias("side"))
    rows = written(rows.unionByName(ends), "points")
    placed = written(rows.repartitionByRange(buckets(rows.sparkSession), *ORDER).withColumn("seg", F.spark_partition_id()), "ranked")
    # a row for each partition
    totals = placed.groupBy("seg").agg(F.count_if(C("kind") == 1).alias("n")).select("seg", (F.sum("n").over(Window.orderBy("seg")) - C("n")).alias("before"))
    running = Window.partitionBy("seg").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumn("n", F.count_if(C("kind") == 1).over(running)).join(F.broadcast(totals), "seg")
    ranks = written(counted.select("kind", "item", "range", "side", (C("before") + C("n")).alias("rank")), "ranks")
    end = lambda side: F.when(C("side") == side, C("rank"))
    spans = ranks.where("kind <> 1").groupBy("range").agg(F.max(end(FROM)).alias("low"), F.min(end(TO)).alias("high")).where("low < high")
    wanted = spans.select("range", F.explode(F.sequence(C("low") + 1, C("high"))).alias("rank"))
    return wanted.join(ranks.where("kind = 1").select("rank", "item"), "rank").select("range", "item")
