"""All named queries; importing the modules registers them."""

from framekit.plans import flagship, q_compare, q_intervals, q_io, q_rules, q_samples, q_text, q_timeline, q_vbi  # noqa: F401
from framekit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
