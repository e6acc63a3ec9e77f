"""Column names and types shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# The extractable product fields, in report order.
FIELDS = (
    "name",
    "current_price",
    "original_price",
    "rating",
    "reviews",
    "discount",
    "offers",
    "delivery",
    "availability",
)

# The fields a selector configuration may set, with their descriptions.
CONFIG_FIELDS = {
    "product_container": "Container element that wraps each product",
    "name": "Product name/title",
    "current_price": "Current selling price",
    "original_price": "Original/MRP price (optional)",
    "rating": "Product rating (1-5 stars)",
    "reviews": "Number of reviews/ratings",
    "discount": "Discount percentage or amount",
    "offers": "Special offers or coupons",
}

# The column order of a stored product row.
PRODUCT_COLUMNS = ("index", *FIELDS, "site", "scraped_at")

# The column order of a stored card row.
CARD_COLUMNS = (
    "product_id",
    "title",
    "current_price",
    "original_price",
    "discount",
    "rating",
    "rating_count",
    "image_url",
    "product_url",
    "wishlist_available",
)

# Fixed value: how a missing field is written in a sink.
MISSING = "N/A"

SELECTOR_TYPES = ("css", "xpath", "regex")

SELECTORS_SCHEMA = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("selector", T.StringType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("regex", T.StringType()),
    ]
)

# One element, text run or comment of a page, in document order. `end_id` closes the subtree, so
# `d` lies below `a` exactly when a.node_id < d.node_id <= a.end_id.
NODE_FIELDS = [
    T.StructField("node_id", T.IntegerType()),
    T.StructField("end_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("child_count", T.IntegerType()),
    T.StructField("sib_idx", T.IntegerType()),
    T.StructField("same_tag_idx", T.IntegerType()),
    # Of an element: its first direct string, and that string's node id. Of a string: itself.
    T.StructField("text", T.StringType()),
    T.StructField("text_id", T.IntegerType()),
]
