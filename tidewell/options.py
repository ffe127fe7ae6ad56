"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    shards: int = 100
    window: int = 7200  # seconds of a bucket
    buckets: int = 13  # closed buckets that are kept
    min_delta: int = 30  # seconds between accepted points of a series
    ahead: int = 60
    behind: int = 900
    blacklist: tuple[int, int] = (0, 0)
    epsilon: float = 0.1
    cold_threshold: int = 0
    missing_logs_threshold: int = 600
    max_key_bytes: int = 400


#: What the registered queries use: 30 days of events fit into 180 buckets of 4 hours.
EVENTS = Options(shards=16, window=14400, buckets=24, epsilon=0.02)
NOW = 1705276800  # 2024-01-15: inside the events, so that repair meets late and early points
