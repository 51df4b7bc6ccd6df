"""All registered queries."""

from . import universe, scores, rates, trades, portfolios, signals, landing, gates  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
