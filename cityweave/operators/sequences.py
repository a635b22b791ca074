"""Trajectories and routes: ordered folds and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import dist_xy
from .spatial import sized_broadcast


def step_distances(visits: DataFrame) -> DataFrame:
    """(traj_id, seq, distance) to the next visit; the last visit has none."""
    w = Window.partitionBy("traj_id").orderBy("seq")
    d = dist_xy(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w))
    return visits.withColumn("distance", d).where("distance is not null")


def gyration_radius(visits: DataFrame) -> DataFrame:
    """(traj_id, radius): mean distance to the trajectory's centre."""
    w = Window.partitionBy("traj_id")
    d = dist_xy(F.col("x"), F.col("y"), F.avg("x").over(w), F.avg("y").over(w))
    return visits.withColumn("d", d).groupBy("traj_id").agg(F.avg("d").alias("radius"))


def topk_locations(visits: DataFrame, k: int) -> DataFrame:
    """(traj_id, rank, loc_id, freq): the k most visited places, padded with (-1, 0)."""
    n = visits.groupBy("traj_id", "loc_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("traj_id").orderBy(F.desc("n"), "loc_id"))
    total = F.sum("n").over(Window.partitionBy("traj_id"))
    ranked = n.withColumns({"rank": rank.cast("long"), "freq": F.col("n") / total}).where(F.col("rank") <= k)
    scaffold = visits.select("traj_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    return scaffold.join(ranked, ["traj_id", "rank"], "left").select("traj_id", "rank", F.coalesce("loc_id", F.lit(-1)).cast("long").alias("loc_id"), F.coalesce("freq", F.lit(0.0)).alias("freq"))


def topk_mass(visits: DataFrame, k: int) -> DataFrame:
    """(loc_id, n, share): how often a place is among the k most visited ones of a trajectory,
    and its share of all such; padding does not count."""
    n = topk_locations(visits, k).where("loc_id <> -1").groupBy("loc_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("loc_id", "n", (F.col("n") / F.col("total")).alias("share"))


def history_target(visits: DataFrame) -> DataFrame:
    """(traj_id, history, target): the last place, and those before in order."""
    last = F.row_number().over(Window.partitionBy("traj_id").orderBy(F.desc("seq")))
    r = visits.withColumn("back", last)
    listed = F.array_sort(F.collect_list(F.when(F.col("back") > 1, F.struct("seq", "loc_id"))))
    out = r.groupBy("traj_id").agg(listed.alias("h"), F.max(F.when(F.col("back") == 1, F.col("loc_id"))).alias("target"))
    return out.select("traj_id", F.transform("h", lambda s: s["loc_id"]).alias("history"), "target")


MERGED = "array<struct<road_name:string,direction:string,length:bigint>>"


def merge_steps(steps: Column, least: int) -> Column:
    """Folds lanes to walkable stretches: a lane of the same road and direction as the
    one before joins it while either is under the least length; a stretch that stays
    under it is dropped when another begins, and at the end."""
    start = F.array().cast(MERGED)
    one = lambda s: F.array(F.struct(s["road_name"].alias("road_name"), s["direction"].alias("direction"), s["road_length"].alias("length")))

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        before = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        same = (last["road_name"] == s["road_name"]) & (last["direction"] == s["direction"]) & ((last["length"] < least) | (s["road_length"] < least))
        grown = F.concat(before, F.array(F.struct(last["road_name"].alias("road_name"), last["direction"].alias("direction"), (last["length"] + s["road_length"]).alias("length"))))
        return F.when(F.size(acc) == 0, one(s)).when(same, grown).when(last["length"] < least, F.concat(before, one(s))).otherwise(F.concat(acc, one(s)))

    def ended(acc):
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["length"] < least), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)

    return F.aggregate(steps, start, step, ended)


def narrate(merged: Column) -> Column:
    """One phrase per stretch, and the junction between neighbours."""
    def phrase(s, i):
        walk = F.concat(F.lit("walk along "), s["road_name"], F.lit(" for "), s["length"].cast("string"), F.lit(" meters "), s["direction"])
        return F.when(i == 0, walk).otherwise(F.concat(F.lit("at the junction turn into "), s["road_name"], F.lit(", "), walk))

    return F.array_join(F.transform(merged, phrase), "; ")


def visit_distribution(visits: DataFrame) -> DataFrame:
    """(kind, loc_id, share): visits by place, consecutive repeats counted once."""
    before = F.lag("loc_id").over(Window.partitionBy("traj_id").orderBy("seq"))
    kept = visits.withColumn("before", before).where("before is null or before <> loc_id")
    n = kept.groupBy("kind", "loc_id").agg(F.count(F.lit(1)).alias("n"))
    total = kept.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return n.join(sized_broadcast(total), "kind").select("kind", "loc_id", "n", (F.col("n") / F.col("total")).alias("share"))


def length_cdf(df: DataFrame, length: str, interval: int) -> DataFrame:
    """(bucket, n, upto, percent): counts by length bucket and their running sum; the
    window runs over one row per bucket."""
    b = df.groupBy((F.floor(F.col(length) / interval) * interval).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy())
    return b.select(F.col("bucket").cast("long"), "n", upto.alias("upto"), (100 * upto / total).alias("percent"))


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; a digest of the key is shuffled, not the key."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    rank = F.row_number().over(Window.partitionBy("_digest").orderBy(order))
    return df.withColumn("_digest", digest).withColumn("_rank", rank).where("_rank = 1").drop("_digest", "_rank")
