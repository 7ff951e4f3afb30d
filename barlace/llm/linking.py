"""Connected groups of rows that share a key and pass a check, without all pairs of a bucket.

``link`` takes bucket rows (key, id, w) and a function that verifies pairs.
Exactness: every pair of ids that shares a key, passes the weight
filter and is not yet known to be connected is verified, either against a bucket's
leader or in the last, exhaustive step.  So the groups equal those of all verified pairs.

* A star round verifies each member of a bucket against one leader only, so a
  bucket of n rows gives n pairs.  Verified pairs are contracted at once.
* Buckets whose members are all connected are finished.  There are ``stars`` such
  rounds at every size, each with another leader.
* What is left is compared pair by pair, across components only.  A bucket of more than
  CHUNK rows is dealt in chunks, of which each meets all rows of the bucket, so no task
  holds all pairs of a large one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

STAR_ROUNDS = 1
#: Rows of a bucket that one task compares with the whole bucket.
CHUNK = 2000


def link(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, fits: str = "true", name: str = "link", stars: int = STAR_ROUNDS
) -> DataFrame | None:
    """(id, comp) for every id with a verified link; None if there is none.

    ``buckets``: key long, id long, w (a struct that ``fits``, SQL on one shared
    key of a pair, may name as wa and wb).  ``verify``: distinct pairs (a, b) with
    a < b to those that hold.  Null keys or ids must have been left out.
    """
    rows, comps, tried, turn = buckets, None, [], 0
    while True:
        if comps is not None:
            joined = rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        else:
            joined = rows.withColumn("comp", F.col("id"))
        joined = joined.withColumn("place", F.xxhash64(F.lit(turn), "id") if turn else F.col("id"))
        open_keys = joined.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("place").alias("first"), F.count("*").alias("m")).where("lo < hi")
        live = scratch.keep(joined.join(open_keys.select("key", "first", "m"), "key"), f"{name}-live{turn}")
        if turn:
            scratch.drop(f"{name}-live{turn - 1}")
        if live.isEmpty():
            break
        last = turn >= stars
        if last:
            chunks = F.expr(f"cast((m - 1) div {CHUNK} as int)")
            one = live.select("key", F.pmod(F.xxhash64("id"), chunks + 1).cast("int").alias("chunk"), F.col("id").alias("a"), F.col("w").alias("wa"), F.col("comp").alias("ca"))
            two = live.select("key", F.explode_outer(F.sequence(F.lit(0), chunks)).alias("chunk"), F.col("id").alias("b"), F.col("w").alias("wb"), F.col("comp").alias("cb"))
            near = one.join(two, ["key", "chunk"]).where(f"ca <> cb and a < b and ({fits})")
        else:
            leads = live.where("place = first").select("key", F.col("id").alias("lead"), F.col("w").alias("lw"), F.col("comp").alias("lcomp")).dropDuplicates(["key"])
            near = (
                live.join(leads, "key")
                .where("comp <> lcomp")
                .select(
                    F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"),
                    F.when(F.col("id") < F.col("lead"), F.col("w")).otherwise(F.col("lw")).alias("wa"),
                    F.when(F.col("id") < F.col("lead"), F.col("lw")).otherwise(F.col("w")).alias("wb"),
                )
                .where(fits)
            )
        pairs = near.select("a", "b").distinct()
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"{name}-pairs{turn}")
        found = scratch.keep(verify(pairs).select("a", "b"), f"{name}-edges{turn}")
        gained = not found.isEmpty()
        if gained:
            known = found if comps is None else found.unionByName(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
            comps = connected_components(known, scratch, f"{name}-cc{turn}")
        if last:
            break
        tried.append(pairs.select("a", "b"))
        rows = live.select("key", "id", "w")
        turn += 1
    return comps
