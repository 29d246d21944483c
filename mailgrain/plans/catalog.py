"""All named queries; importing the modules registers them."""

from mailgrain.plans import parse_queries, report_queries, store_queries, stream_queries  # noqa: F401
from mailgrain.plans.registry import ORACLES, QUERIES  # noqa: F401
