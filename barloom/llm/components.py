"""Connected components of a link table, as rounds of joins and minima.

Alternating large-star and small-star steps turn any graph into stars whose
centres are the smallest node of each component, in a logarithmic number of
rounds.  Only minima per node are aggregated (map-side first), never neighbour
lists, so a node that has a third of all links costs no task more than another:
its link rows are split by the skew-aware join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import shared_dir


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _nearest(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = _nearest(links)
    moved = links.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def _is_stars(links: DataFrame) -> bool:
    """True if every u has one v and no v is itself a u."""
    marks = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        links.select("v", F.lit(0), F.lit(1))
    )
    seen = marks.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter("out > 1 or (out > 0 and into > 0)").limit(1).count() == 0


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Return (node, root) for every node that has a link; root is the smallest node.

    ``links``: any columns, of which ``a`` and ``b`` name the two ends.  Self links,
    repeated links and links with a null end add nothing; an empty table gives none.
    """
    shared_dir(links.sparkSession)
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("p"), F.col(b).alias("q"))
    stars = ends.filter("p is not null and q is not null and u > v").select("u", "v").distinct().checkpoint()
    while not _is_stars(stars):
        stars = _small_star(_large_star(stars).distinct()).distinct().checkpoint()
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.union(centres)
