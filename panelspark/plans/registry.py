"""All registered queries of the library and their oracle SQL."""

from panelspark.plans import evaluation, events, market, products, texts
from panelspark.plans.registering import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "events", "market", "products", "texts"]
