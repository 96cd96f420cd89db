"""Parent chains by pointer doubling: after k rounds every node knows its 2^k nearest ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut_lineage

# Rounds (512 hops) before cycles are looked for; no result depends on it.
PATIENCE = 9


def _advanced(moving: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """One round: every moving chain takes over what the node at its top knows; ``_moved`` says whether there was such a node."""
    upper = known.select(*keys, F.col("node").alias("top"), F.col("names").alias("_names"), F.col("top").alias("_top"), F.col("hops").alias("_hops"))
    step = moving.join(upper, [*keys, "top"], "left")
    moved = F.col("_hops").isNotNull()
    return step.select(
        *keys, "node",
        F.when(moved, F.concat("_names", "names")).otherwise(F.col("names")).alias("names"),
        F.when(moved, F.col("_top")).otherwise(F.col("top")).alias("top"),
        (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
        moved.alias("_moved"),
    )


def endless(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node) of the nodes whose chain never ends: those of cycles, and those that lead into one.

    A chain that ends has fewer hops than there are nodes; hops double each round, so what still moves after that many is
    endless. Only numbers are carried.
    """
    known = cut_lineage(nodes.select(*keys, "node", F.array().cast("array<string>").alias("names"), F.col("parent").alias("top"), F.lit(1).cast("bigint").alias("hops")))
    moving, done, count, reach = known, [], known.count(), 1
    while reach <= count:
        step = cut_lineage(_advanced(moving, known, keys))
        done.append(step.filter("NOT _moved").drop("_moved"))
        moving = step.filter("_moved").drop("_moved")
        if moving.isEmpty():
            break
        known = union_by_name([*done, moving])
        reach *= 2
    return moving.select(*keys, "node")


def climb(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Join the names of all ancestors, however deep.

    ``nodes`` has ``keys``, ``node``, ``parent`` and ``names`` (array, one element for the node itself). The result has
    ``names`` root-most first, ``top`` (the first missing or terminal parent reached) and ``hops``; both names and top are NULL
    for a chain that ends in a cycle. A round joins the chains that still move, and a chain of depth d needs about log2(d)
    rounds. Chains that ended are set aside. When chains still move after ``PATIENCE`` rounds, cycles are looked for once and
    taken out, as their names would grow without end.
    """
    known = cut_lineage(nodes.select(*keys, "node", "names", F.col("parent").alias("top"), F.lit(1).cast("bigint").alias("hops")))
    moving, done, rounds = known, [], 0
    while True:
        step = cut_lineage(_advanced(moving, known, keys))
        settled, moving = step.filter("NOT _moved").drop("_moved"), step.filter("_moved").drop("_moved")
        done.append(settled)
        if moving.isEmpty():
            break
        rounds += 1
        if rounds == PATIENCE:
            cyclic = endless(nodes, keys)
            lost = moving.join(cyclic, [*keys, "node"], "left_semi")
            done.append(lost.withColumn("names", F.lit(None).cast("array<string>")).withColumn("top", F.lit(None).cast(lost.schema["top"].dataType)))
            moving = cut_lineage(moving.join(cyclic, [*keys, "node"], "left_anti"))
            if moving.isEmpty():
                break
        # what a node knows: its whole chain if that ended, else as far as it has come
        known = union_by_name([*done, moving])
    return union_by_name(done)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def path_text(names: Column) -> Column:
    """Backslash-joined non-empty names with a leading backslash each."""
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("\\"), F.array_join(kept, "\\")))
