import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagequarry.session import local_session

    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pages_of(spark):
    def make(*htmls, site="s"):
        rows = [(i, h, site) for i, h in enumerate(htmls)]
        return spark.createDataFrame(rows, "page_id bigint, html string, site string")

    return make


@pytest.fixture(scope="session")
def nodes_of(pages_of):
    from pagequarry.sources.parse import node_rows, parse_pages

    def make(*htmls, elements_only=True, **options):
        return node_rows(parse_pages(pages_of(*htmls), **options), elements_only)

    return make
