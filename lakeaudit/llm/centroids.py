"""Operator 11: centroid clustering in exact integers, in JVM-native expressions.

A vector of ``width`` components becomes integers, floor(scale * x) of each. The first centroids are the ``k`` vectors of least
sha256 of "salt:id". A round assigns every vector to the nearest centroid: ``zip_with`` and ``aggregate`` give the squared
distance to each of the literal centroid arrays, ``array_min`` of (distance, number) structs chooses, so that of equal ones the
smaller number holds. One sum for each component, grouped by cluster, then moves the centroids: at most ``k`` rows of sums are
all that reaches the driver in a round, and rows are combined before they are shuffled, however many a cluster has. The integers
are written once and read by every round; nothing else is kept.

Vectors of another length, null ones, and those with null or non-finite components are left out. Components are held within
2**30 / sqrt(width) (2**27 at 64), where all sums of squares are exact in 64 bits; what lies beyond counts as that bound. Null
ids: clustered like any other, but never a first centroid. Repeated rows are separate vectors; if the first centroids tie in
their id, the lesser integers go first. With fewer vectors than ``k`` there are as many centroids; an empty cluster keeps its
centroid. An empty table gives no rows. Of the input only the id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.text import durable

WIDTH, SCALE, CENTROIDS, ROUNDS, SALT = 64, 64, 16, 3, "1"
_MOST_LONG = (1 << 63) - 1


def integers(x: Column, scale: int, bound: int) -> Column:
    """floor(scale * x) of every component, within +-bound."""
    return F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-bound)), F.least(F.lit(float(bound)), c * scale))).cast("long"))


def finite(x: Column) -> Column:
    """Whether an array has no null and no non-finite component; false for a null array."""
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _literal(centroids: list[list[int]]) -> Column:
    """Arrays of constants, which the optimizer folds into one."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")


def nearest(q: Column, centroids: list[list[int]]) -> Column:
    """struct<distance long, cluster int> of the nearest centroid."""
    squared = lambda c: F.aggregate(F.zip_with(q, c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    return F.array_min(F.transform(_literal(centroids), lambda c, i: F.struct(squared(c).alias("distance"), i.alias("cluster"))))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """Of rows(id, q) the k of least hash, in its order."""
    hashed = rows.where("id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h"), "q")
    return [list(r["q"]) for r in hashed.orderBy("h", "q").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without any stays."""
    width = len(centroids[0])
    held = rows.select("q", nearest(F.col("q"), centroids)["cluster"].alias("cluster"))
    sums = held.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(width)))
    out = list(centroids)
    for r in sums.collect():  # a row for each centroid at most
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", width: int = WIDTH, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT
) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string), final centroids); a row for
    each vector that is kept."""
    bound = int(math.isqrt((1 << 60) // width))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
    rows = durable(rows.where((F.size("x") == width) & finite(F.col("x"))).select("id", integers(F.col("x"), scale, bound).alias("q")))
    centroids = first_centroids(rows, k, salt)
    if not centroids and not rows.isEmpty():
        raise ValueError("no vector has an id, so there is no first centroid")
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    found = rows.select("id", nearest(F.col("q"), centroids).alias("best")) if centroids else rows.select("id", F.lit(None).cast("struct<distance: bigint, cluster: int>").alias("best"))
    found = durable(found.select("id", "best.cluster", "best.distance"))
    # Sums of 38 digits, as those of extreme vectors pass 64 bits; they are held at what a long can say.
    parts = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = lambda n: min(n, _MOST_LONG)
    within = [most(parts.get(i, 0)) for i in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.get(F.lit(values), F.col("cluster")) if values else F.lit(None)
    out = found.select(
        F.col("id").alias(id_column), "cluster", "distance", of_cluster(within).cast("long").alias("cluster_inertia"),
        F.lit(most(sum(parts.values()))).cast("long").alias("inertia"), of_cluster(hashes).cast("string").alias("centroid_sha256"),
    )
    return out, centroids
