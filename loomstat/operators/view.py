"""What a viewer of networks and bundles asks of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colours of a palette from which those without a colour of their own take theirs.
PALETTE = 39


def tree_model(edges: DataFrame) -> DataFrame:
    """(network, bundle, n): each bundle once under each of its networks, with its edges. Null labels are left out."""
    return edges.where("network IS NOT NULL AND bundle IS NOT NULL").groupBy("network", "bundle").agg(F.count("*").alias("n"))


def selection_summary(chosen: DataFrame) -> DataFrame:
    """(network, bundles): the chosen bundles of each network, ascending, as text; All if a null bundle chooses all of it."""
    every = F.max(F.col("bundle").isNull())
    some = F.array_join(F.transform(F.sort_array(F.collect_set("bundle")), lambda b: b.cast("string")), ", ")
    return chosen.where("network IS NOT NULL").groupBy("network").agg(F.when(every, F.lit("All")).otherwise(some).alias("bundles"))


def colours(edges: DataFrame, of_bundles: DataFrame, of_networks: DataFrame, palette: int = PALETTE) -> DataFrame:
    """(network, bundle, colour): a bundle's own colour, or else its network's, or else the number of the bundle in the palette.

    of_bundles (network, bundle, colour) and of_networks (network, colour) may be empty; of several colours of one the smallest counts.
    """
    b = of_bundles.groupBy("network", "bundle").agg(F.min("colour").alias("b"))
    n = of_networks.groupBy("network").agg(F.min("colour").alias("n"))
    tree = tree_model(edges).select("network", "bundle").join(b, ["network", "bundle"], "left").join(n, "network", "left")
    return tree.select("network", "bundle", F.coalesce("b", "n", F.concat(F.lit("palette "), F.pmod("bundle", F.lit(palette)).cast("string"))).alias("colour"))
