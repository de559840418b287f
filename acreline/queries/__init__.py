"""All registered queries."""

from acreline.queries import (cleaning, entities, forecasting, inputs,  # noqa: F401
                              joining, market, reconciling, summaries)
from acreline.queries.base import REGISTRY

__all__ = ["REGISTRY"]
