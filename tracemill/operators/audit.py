"""Identity audits: claims that two figures agree, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Each identity and the share of its sites that may violate it.
IDENTITIES: dict[str, float] = {
    "tree-holds-every-token": 0.0,
    "cache-creation-accounted": 0.0,
    "cache-read-recurrence": 0.05,
    "output-snapshot-agrees": 0.001,
    "residency-predicts-cache-read": 0.3,
}


def rate_of(identity: str) -> float:
    """The admitted rate; an unknown name is an error that lists the known ones."""
    if identity not in IDENTITIES:
        raise KeyError(f"no identity named {identity!r}; known: {', '.join(IDENTITIES)}")
    return IDENTITIES[identity]


def audits(claims: DataFrame, identities: dict[str, float] | None = None) -> DataFrame:
    """``identity``, ``sites``, ``violations``, ``allowed`` and ``held``, a row for every identity, also those without a site.

    ``claims`` has ``identity``, ``session``, ``site``, ``lhs`` and ``rhs``.
    """
    known = claims.sparkSession.createDataFrame([*(identities or IDENTITIES).items()], "identity string, rate double")
    counts = claims.groupBy("identity").agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.col("lhs") != F.col("rhs")).alias("violations"))
    return (
        known.join(counts, "identity", "left")
        .fillna(0, ["sites", "violations"])
        .withColumn("allowed", F.floor(F.col("rate") * F.col("sites")))
        .withColumn("held", F.col("violations") <= F.col("allowed"))
        .drop("rate")
    )


#: Parts that one identity's violations are ranked in before they meet.
PARTS = 256


def violations(claims: DataFrame, show: int = 5) -> DataFrame:
    """The first ``show`` violations of each identity with their difference ``delta``, place ``n`` and how many there are (``count``, never cut off).

    Each identity's violations are ranked in parts, and only the first ``show`` of each
    part meet, so an identity that nearly every site violates is no burden to one task.
    """
    broken = claims.filter("lhs <> rhs").withColumn("delta", F.col("lhs") - F.col("rhs"))
    order = ["session", "site", "lhs", "rhs"]
    counts = broken.groupBy("identity").agg(F.count(F.lit(1)).alias("count"))
    part = F.pmod(F.xxhash64("session", "site"), F.lit(PARTS))
    first = broken.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("identity", "_part").orderBy(*order))).filter(F.col("_n") <= show)
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("identity").orderBy(*order))).filter(F.col("n") <= show)
    return ranked.drop("_part", "_n").join(F.broadcast(counts), "identity")
