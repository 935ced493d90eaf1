"""The tree of a site's routes: modules below their layouts, with layouts that have no path of their own spliced out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.session import cut_afresh


def route_tree(modules: DataFrame) -> DataFrame:
    """file, route, parent, depth and path of ``modules`` (file, route, parent), in the order of the tree.

    ``parent`` is the file of a module's layout, null at the root. A module whose route is null takes no part: its
    children belong to the nearest layout above that has a route. ``depth`` counts those, ``path`` shows their routes.
    Siblings come by route, then by file. Modules that no chain of layouts joins to the root are left out: those below
    a missing file, on a ring of layouts or below one. Files are unique. Every round doubles how far up each module
    sees, so n levels take log n rounds.
    """
    node = F.when(F.col("route").isNotNull(), F.array(F.struct("route", "file"))).otherwise(F.array().cast("array<struct<route:string,file:string>>"))
    state = cut_afresh(modules.select("file", F.col("parent").alias("next"), node.alias("own"), node.alias("trail")))
    open_ = state.where("next is not null").count()
    while open_:
        above = state.select(F.col("file").alias("next"), F.col("next").alias("after"), F.col("trail").alias("higher"))
        seen = state.where("next is not null").join(above, "next").select("file", F.col("after").alias("next"), "own", F.concat("higher", "trail").alias("trail"))
        state = cut_afresh(state.where("next is null").unionByName(seen))
        left = state.where("next is not null").count()
        if left == open_:  # rings, and what hangs from them
            break
        open_ = left
    rows = state.where("next is null and size(own) > 0")
    parent = F.when(F.size("trail") > 1, F.element_at("trail", -2)["file"])
    shown = rows.select("file", F.col("own")[0]["route"].alias("route"), parent.alias("parent"), (F.size("trail") - 1).alias("depth"), F.array_join("trail.route", " > ").alias("path"), "trail")
    return shown.orderBy("trail").drop("trail")
