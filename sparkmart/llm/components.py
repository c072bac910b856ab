"""Connected components of a graph given by its edges, with the smallest vertex as a component's id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def star_edges(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(u, v) with v the smallest vertex of u's component, for every u that an edge reaches and that isn't v itself.

    Rounds of a large star (each vertex's larger neighbours go to its smallest) and a small star (its
    smaller ones do) until nothing changes; their number grows with the logarithm of the vertices. Minima
    are summed up before they are dealt out, and written: a join of two written tables deals both out by
    itself, so that adaptive execution can split the partition of a vertex that a large part of all edges has.
    A round's tables go when the next one has its own.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def seen(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()

    now = scratch.write(edges, "stars0")
    before = seen(now)
    for k in range(1, limit + 1):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{k}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, f"large{k}")
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"lower{k}")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small, f"stars{k}")
        what = seen(new)
        for old in (f"stars{k - 1}", f"least{k}", f"large{k}", f"lower{k}"):
            scratch.drop(old)
        now = new
        if what == before or not what["n"]:
            return now
        before = what
    raise RuntimeError(f"no end after {limit} rounds")
