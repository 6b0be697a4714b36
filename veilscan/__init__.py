"""Discovery of sensitive data with Spark: rules, scoring, findings, honeytoken alerts."""

from __future__ import annotations

__version__ = "0.1.0"
