"""The page reader as a table function for SQL: `from pages, lateral page_nodes(html)`.

    page_nodes(html [, text => 'raw' | 'plain' | 'stripped'] [, xpath => true])

One row per element, string and comment of a page, in document order. The columns follow from the arguments: `content`, the
node's text of that flavour, and `xpath` are there only if asked for.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagequarry.schema import NODE_FIELDS
from pagequarry.sources import parse

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The members of a node that do not depend on the page's row.
NAMES = ("node_id", "end_id", "parent_id", "depth", "kind", "tag", "attrs", "child_count", "text")
FIELDS = [f for f in NODE_FIELDS if f.name in NAMES]


class PageNodes:
    """See the module; a NULL or blank page has no rows, and a page that cannot be read fails the query."""

    @staticmethod
    def analyze(html: AnalyzeArgument, text: AnalyzeArgument | None = None, xpath: AnalyzeArgument | None = None) -> AnalyzeResult:
        if html.dataType != T.StringType():
            raise ValueError("page_nodes needs the html as a string")
        for option in (text, xpath):
            if option is not None and not option.isConstantExpression:
                raise ValueError("the options of page_nodes are constants: the columns follow from them")
        if text is not None and text.value not in parse.TEXTS:
            raise ValueError(f"text is one of {', '.join(parse.TEXTS)}")
        schema = T.StructType(list(FIELDS))
        if text is not None:
            schema = schema.add("content", T.StringType())
        if xpath is not None and xpath.value:
            schema = schema.add("xpath", T.StringType())
        return AnalyzeResult(schema)

    def eval(self, html, text=None, xpath=None):
        if html is None or not html.strip():
            return
        page = parse._Page(html, (text,) if text else (), False)
        paths = list(parse._xpaths(page)) if xpath else None
        for number, node in enumerate(page.nodes):
            row = (
                number,
                node[parse.END],
                node[parse.PARENT],
                node[parse.DEPTH],
                node[parse.KIND],
                node[parse.TAG],
                parse._attributes(node[parse.ATTRS]),
                node[parse.CHILDREN],
                node[parse.STRING],
            )
            if text:
                start, stop = node[parse.SPANS], node[parse.SPANS + 1]
                row += (bytes(page.blobs[0][start:stop]).decode("utf-8", "replace"),)
            yield (*row, paths[number]) if xpath else row


def register(spark: SparkSession, name: str = "page_nodes") -> None:
    spark.udtf.register(name, udtf(PageNodes, useArrow=True))
