"""Screen tiles of a bitmap cache file: which tiles touch, which picture fragments they form, which are left over."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# An edge shared by more tiles says nothing; smallest fragment; largest grid; pixels per tile.
MAX_EDGE_SHARE = 8
MIN_FRAGMENT = 2
MAX_GRID = 200
TILE_PIXELS = 64


def usable_edge(edge_hex: Column) -> Column:
    """NULL for an edge of one colour (three bytes per pixel), which would match anything."""
    return F.when(~edge_hex.rlike(r"^(.{6})\1*$|^.{0,5}$"), edge_hex)


def _neighbour(tiles: DataFrame, keys: list[str], size: str, near: str, far: str, name: str) -> DataFrame:
    """For each tile the lowest other tile whose ``near`` edge equals the tile's ``far`` edge."""
    edges = tiles.filter(F.col(near).isNotNull()).select(*keys, size, F.col(near).alias("_edge"), "tile")
    shared = edges.groupBy(*keys, size, "_edge").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= MAX_EDGE_SHARE)
    # Only now the groups are known to be small, so listing their tiles is bounded.
    groups = edges.join(shared, [*keys, size, "_edge"]).groupBy(*keys, size, "_edge").agg(F.array_sort(F.collect_list("tile")).alias("_tiles"))
    seekers = tiles.filter(F.col(far).isNotNull()).select(*keys, size, F.col(far).alias("_edge"), "tile")
    others = F.filter("_tiles", lambda t: t != F.col("tile"))
    return (
        seekers.join(groups, [*keys, size, "_edge"])
        .select(*keys, "tile", F.get(others, F.lit(0)).alias(name))
        .filter(F.col(name).isNotNull())
    )


def adjacency(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with their right and lower neighbour."""
    right = _neighbour(tiles, keys, "h", "left_edge", "right_edge", "right_of")
    down = _neighbour(tiles, keys, "w", "top_edge", "bottom_edge", "down_of")
    return tiles.select(*keys, "tile").join(right, [*keys, "tile"], "left").join(down, [*keys, "tile"], "left")


def both_ways(links: DataFrame, keys: list[str]) -> DataFrame:
    """Add the inverse links; when two tiles claim the same neighbour the later tile wins."""
    left = links.filter("right_of is not null").groupBy(*keys, F.col("right_of").alias("tile")).agg(F.max(links["tile"]).alias("left_of"))
    up = links.filter("down_of is not null").groupBy(*keys, F.col("down_of").alias("tile")).agg(F.max(links["tile"]).alias("up_of"))
    return links.join(left, [*keys, "tile"], "left").join(up, [*keys, "tile"], "left")


def _place(tiles: pd.DataFrame) -> pd.DataFrame:
    """Breadth-first placement of one cache file's tiles, in tile order."""
    tiles = tiles.sort_values("tile")
    steps = (("right_of", 1, 0), ("down_of", 0, 1), ("left_of", -1, 0), ("up_of", 0, -1))
    links = {
        int(r["tile"]): [(int(r[c]), dx, dy) for c, dx, dy in steps if pd.notna(r[c])] for r in tiles.to_dict("records")
    }
    placed: dict[int, tuple[int, int, int]] = {}
    for start in links:
        if start in placed:
            continue
        placed[start] = (start, 0, 0)
        taken = {(0, 0)}
        queue = deque([start])
        while queue:
            current = queue.popleft()
            _, x, y = placed[current]
            for other, dx, dy in links[current]:
                cell = (x + dx, y + dy)
                if other in placed or cell in taken:
                    continue
                placed[other] = (start, *cell)
                taken.add(cell)
                queue.append(other)
    out = pd.DataFrame([(t, *p) for t, p in placed.items()], columns=["tile", "component", "x", "y"])
    return out


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """Component and grid position of every tile. A cache file is bounded by its format, so it is the unit of work."""
    fields = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + ["tile bigint", "component bigint", "x int", "y int"])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _place(pdf)
        for at, key in enumerate(keys):
            out.insert(at, key, pdf[key].iloc[0])
        return out

    return links.groupBy(*keys).applyInPandas(place, schema)


def fragments(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Picture fragments of at least two tiles, numbered by size within their file; an oversized grid says so in ``oversized``."""
    sized = placed.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("tile_count"),
        (F.max("x") - F.min("x") + 1).alias("cols"),
        (F.max("y") - F.min("y") + 1).alias("rows"),
    ).filter(F.col("tile_count") >= MIN_FRAGMENT)
    order = Window.partitionBy(*keys).orderBy(F.desc("tile_count"), "component")
    return (
        sized.withColumn("fragment_index", F.row_number().over(order))
        .select(
            *keys, F.lit("fragment").alias("kind"), "fragment_index", "tile_count", "cols", "rows",
            (F.col("cols") * TILE_PIXELS).alias("width"), (F.col("rows") * TILE_PIXELS).alias("height"),
            ((F.col("cols") > MAX_GRID) | (F.col("rows") > MAX_GRID)).alias("oversized"),
        )
    )


def single_tiles(tiles: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles in no fragment, one per exact content with its count; the lowest tile stands for the rest."""
    alone = placed.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(*keys, F.col("component").alias("tile"))
    return distinct_tiles(tiles.join(alone, [*keys, "tile"], "left_semi"), keys)


def distinct_tiles(tiles: DataFrame, keys: list[str]) -> DataFrame:
    return (
        tiles.withColumn("_content", F.sha2(F.col("rgb"), 256))
        .groupBy(*keys, "_content").agg(F.count(F.lit(1)).alias("count"), F.min("tile").alias("tile_index"))
        .drop("_content").withColumn("kind", F.lit("tile"))
    )
