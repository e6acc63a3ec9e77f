"""Every enclosing box of every event, without forming candidate pairs.

Boxes of one nesting level never overlap. So each event is copied once per box that really encloses
it, and at each level the box opened last is the one: two running windows over document order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing(rows: DataFrame, box: str, event: str, payload: list[str], own: tuple[str, ...] = ()) -> DataFrame:
    """`rows` has page_id, node_id, end_id and two boolean columns. Output: page_id, box_id, node_id
    and the payload of each event, once per box around it. With `own`, each box is also a row of itself,
    the only one with these columns: so boxes without events are kept and need no join."""
    marks = F.array_compact(
        F.array(
            # An event comes before its own opening: a box does not enclose itself.
            F.when(F.col(event), F.struct(F.col("node_id").alias("at"), F.lit(0).alias("step"))),
            F.when(F.col(box), F.struct(F.col("node_id").alias("at"), F.lit(1).alias("step"))),
            F.when(F.col(box), F.struct(F.col("end_id").alias("at"), F.lit(2).alias("step"))),
        )
    )
    kept = [F.when(F.col(event), F.col(c)).alias(c) for c in payload]
    kept += [F.when(F.col(box), F.col(c)).alias(c) for c in own]
    marked = (
        rows.filter(F.col(box) | F.col(event))
        .select("page_id", "node_id", *kept, F.explode(marks).alias("m"))
        .select("page_id", "node_id", *payload, *own, "m.at", "m.step")
    )
    order = Window.partitionBy("page_id").orderBy("at", "step")
    change = F.when(F.col("step") == 1, 1).when(F.col("step") == 2, -1).otherwise(0)
    open_boxes = F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    levels = F.when(F.col("step") == 1, F.array("open")).when(
        F.col("open") > 0, F.sequence(F.lit(1), F.col("open"))
    )
    by_level = (
        marked.withColumn("open", open_boxes)
        .filter("step < 2")
        .withColumn("level", F.explode(levels))
    )
    here = (
        Window.partitionBy("page_id", "level")
        .orderBy("at", "step")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    owner = F.last(F.when(F.col("step") == 1, F.col("node_id")), ignorenulls=True).over(here)
    opening = F.col("step") == 1
    return (
        by_level.withColumn("box_id", owner)
        .filter("step < 2" if own else "step = 0")
        .select(
            "page_id",
            "box_id",
            "node_id",
            *[F.when(~opening, F.col(c)).alias(c) for c in payload],
            *[F.when(opening, F.col(c)).alias(c) for c in own],
        )
    )
