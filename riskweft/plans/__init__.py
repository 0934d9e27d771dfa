"""Registered queries.  Importing the package fills the registry."""

from riskweft.plans.registry import REGISTRY
from riskweft.plans import (  # noqa: F401
    analysis,
    charts,
    cleaning,
    models,
    portfolio,
    quality,
    states,
    storage,
    temporal,
)

__all__ = ["REGISTRY"]
