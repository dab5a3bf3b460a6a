"""Imports every query module, which registers its queries."""

from driver import (  # noqa: F401
    catalog_queries,
    contract_queries,
    health_queries,
    plan_queries,
    run_queries,
    signal_queries,
    store_queries,
    stream_queries,
    validate_queries,
)
from driver.registry import QUERIES, SQL  # noqa: F401
