"""linkweave: relation discovery, evidence and event reduction as Spark DataFrame jobs."""

from linkweave.config import HeaderRules, Limits, ValueRules

__all__ = ["HeaderRules", "Limits", "ValueRules"]
