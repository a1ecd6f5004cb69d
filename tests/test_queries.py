"""Every query of the reference's operators against its SQL."""

import pytest

from broadsheet.plans import (  # noqa: F401  (register themselves)
    asset_queries, catalog, edition_queries, markup_queries, relational_queries, run_queries, scalar_queries, source_queries, stream_queries, tree_queries,
)
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    d = f"{DATA}/sf0.001"
    compare(catalog.QUERIES[name](spark, d), d, catalog.SQL[name])
