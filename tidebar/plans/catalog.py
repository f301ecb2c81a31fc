"""All queries of the time-series engine and their SQL counterparts."""

from __future__ import annotations

from . import features, flows, live, market, more, pieces, research, trading  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "g05_donchian_signals"
