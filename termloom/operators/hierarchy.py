"""SubClassOf edges: closure, and how a predicted code lies to the gold codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

# How a prediction may lie to a gold code.
NA, SAME, NARROWER, BROADER, SIBLING, UNRELATED = "Not Applicable", "Same", "More Specific", "More General", "Sibling", "Unrelated"


def closure(edges: DataFrame) -> DataFrame:
    """All pairs subject, object with a path between them, of any length, cycles included.

    A subject is one row with the objects nearer than some length and those just that far. A round doubles the length: whatever lies further away lies
    behind one of the latter, so only these are looked up, and the work follows the pairs that there are, not the paths between them. It ends when nothing lies that far."""
    edges = edges.select("subject", "object").where("subject IS NOT NULL AND object IS NOT NULL")
    none = F.array().cast(f"array<{edges.schema['object'].dataType.simpleString()}>")
    known = written(edges.groupBy("subject").agg(F.collect_set("object").alias("far")).select("subject", none.alias("near"), "far"))
    while not (going := known.where(F.size("far") > 0)).isEmpty():
        via = going.select(F.col("subject").alias("_start"), F.explode("far").alias("_via"))
        beyond = via.join(known, F.col("_via") == F.col("subject")).select(F.col("_start").alias("subject"), "near", "far")
        own = going.select("subject", F.concat("near", "far").alias("near"), none.alias("far"))
        met = own.unionByName(beyond).groupBy("subject").agg(F.collect_list("near").alias("near"), F.collect_list("far").alias("far"))
        met = met.select("subject", F.array_distinct(F.flatten("near")).alias("near"), F.flatten("far").alias("far"))
        new = written(met.select("subject", "near", F.array_except("far", "near").alias("far")))
        known = new.unionByName(known.where(F.size("far") == 0))
    return known.select("subject", F.explode("near").alias("object"))


def related(pairs: DataFrame, asserted: DataFrame, entailed: DataFrame) -> DataFrame:
    """pairs: id, predicted and gold (an array). Adds relationship, matched_gold (the first in the list's order) and shared_parent
    (the least one of a sibling). A code that the hierarchy lacks is unrelated to all others."""
    one = pairs.select("id", "predicted", F.posexplode_outer("gold").alias("ord", "g"))
    a = entailed.select(F.col("subject").alias("s1"), F.col("object").alias("o1"), F.lit(True).alias("narrower")).distinct()
    b = entailed.select(F.col("subject").alias("s2"), F.col("object").alias("o2"), F.lit(True).alias("broader")).distinct()
    p1, p2 = asserted.select(F.col("subject").alias("predicted"), F.col("object").alias("parent")), asserted.select(F.col("subject").alias("g"), F.col("object").alias("parent"))
    shared = one.select("predicted", "g").distinct().join(p1, "predicted").join(p2, ["g", "parent"]).groupBy("predicted", "g").agg(F.min("parent").alias("parent"))
    one = one.join(a, (F.col("predicted") == F.col("s1")) & (F.col("g") == F.col("o1")), "left").join(b, (F.col("predicted") == F.col("o2")) & (F.col("g") == F.col("s2")), "left").join(shared, ["predicted", "g"], "left")
    hit = lambda ok: F.bool_or(F.coalesce(ok, F.lit(False)))
    same, sibling = F.col("predicted") == F.col("g"), F.col("parent").isNotNull()
    per = one.groupBy("id").agg(
        F.first("predicted").alias("p"), F.count("g").alias("n"), hit(same).alias("same"), hit(F.col("narrower")).alias("narrower"), hit(F.col("broader")).alias("broader"), hit(sibling).alias("sibling"),
        F.min(F.when(F.col("narrower"), F.struct("ord", "g"))).alias("gn"), F.min(F.when(F.col("broader"), F.struct("ord", "g"))).alias("gb"), F.min(F.when(sibling, F.struct("ord", "g", "parent"))).alias("gs"),
    )
    none = F.col("p").isNull() | (F.col("p") == "") | (F.col("n") == 0)
    kind = F.when(none, NA).when(F.col("same"), SAME).when(F.col("narrower"), NARROWER).when(F.col("broader"), BROADER).when(F.col("sibling"), SIBLING).otherwise(UNRELATED)
    per = per.withColumn("relationship", kind)
    gold = F.when(F.col("relationship") == SAME, F.col("p")).when(F.col("relationship") == NARROWER, F.col("gn.g")).when(F.col("relationship") == BROADER, F.col("gb.g")).when(F.col("relationship") == SIBLING, F.col("gs.g"))
    found = per.select("id", "relationship", gold.alias("matched_gold"), F.when(F.col("relationship") == SIBLING, F.col("gs.parent")).alias("shared_parent"))
    return pairs.join(found, "id")


def known(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """The codes (column code) that the hierarchy has."""
    ends = edges.select(F.col("subject").alias("code")).unionByName(edges.select(F.col("object").alias("code"))).distinct()
    return codes.join(ends, "code", "left_semi")
