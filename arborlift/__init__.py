"""Counterfactual forest-impact analytics expressed as Spark DataFrame plans."""

from arborlift.config import MatchConfig

__all__ = ["MatchConfig"]
