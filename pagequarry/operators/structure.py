"""Tree questions as running windows over document order.

Every question below is answered for all rows of a page in one sorted pass. No row pairs are formed,
so cost stays linear in a page's nodes however deeply they nest, and all windows share one shuffle
on the page key.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PAGE = ("page_id",)


def inside(match: Column, keys: tuple[str, ...] = PAGE) -> Column:
    """Has the row an ancestor for which `match` holds?

    An earlier node whose subtree ends at or after this row is an ancestor, so the largest `end_id`
    of earlier matches decides.
    """
    earlier = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(match, F.col("end_id"))).over(earlier)
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def holds(match: Column, keys: tuple[str, ...] = PAGE) -> Column:
    """Has the row a descendant for which `match` holds? The next match after it decides."""
    later = Window.partitionBy(*keys).orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)
    near = F.min(F.when(match, F.col("node_id"))).over(later)
    return F.coalesce(near <= F.col("end_id"), F.lit(False))


def follows(match: Column, keys: tuple[str, ...] = PAGE) -> Column:
    """Is the element right before this one, among its siblings, one for which `match` holds?"""
    before = (
        Window.partitionBy(*keys, "parent_id")
        .orderBy("node_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    near = F.last(F.when(match, F.col("sib_idx")), ignorenulls=True).over(before)
    return F.coalesce(near == F.col("sib_idx") - 1, F.lit(False))


def first_below(event: str, keys: tuple[str, ...] = PAGE, with_self: bool = False) -> Column:
    """First event in document order after this row; `event` names a struct column that starts with
    the node id.

    It lies in the row's own subtree exactly when its node id is at most the row's `end_id`: an
    event past the subtree would come after every event inside it.
    """
    last = "current row" if with_self else "1 preceding"
    return F.expr(
        f"min({event}) over (partition by {', '.join(keys)} order by node_id desc "
        f"rows between unbounded preceding and {last})"
    )


def page_min(value: Column, keys: tuple[str, ...] = PAGE) -> Column:
    return F.min(value).over(Window.partitionBy(*keys))


def running_count(match: Column, keys: tuple[str, ...] = PAGE) -> Column:
    """1-based position among the matching rows of a page."""
    upto = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(match, 1).otherwise(0)).over(upto).cast("int")
