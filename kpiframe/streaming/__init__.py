"""Structured Streaming refresh of KPI aggregates."""

from kpiframe.streaming.refresh import read_current, refresh_every, refresh_once

__all__ = ["read_current", "refresh_every", "refresh_once"]
