"""Options of the engine: one frozen dataclass per concern, read from the environment by the documented names."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping


def parse_bool(value: str | None, default: bool = False) -> bool:
    """1, true, yes and on (any case) are true; None gives the default; all else is false."""
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


@dataclasses.dataclass(frozen=True)
class CrawlOptions:
    max_depth: int = 2
    max_pages: int = 200
    crawl_delay_sec: float = 3.0
    allow_offsite_links: bool = False
    worker_tasks: int = 4
    fetch_timeout_sec: float = 15.0
    visibility_timeout_ms: int = 300_000
    rate_limit_sleep_sec: float = 0.5
    bloom_bits: int = 1 << 23
    bloom_hashes: int = 7
    recrawl_hours: float = 24.0
    max_retries: int = 3
    retry_base_sec: float = 5.0
    retry_cap_sec: float = 300.0
    retry_poll_sec: float = 2.0
    max_body_bytes: int = 5 * 1024 * 1024


@dataclasses.dataclass(frozen=True)
class IndexOptions:
    batch_size: int = 25
    poll_sec: float = 5.0
    pagerank_interval_sec: float = 30.0
    damping: float = 0.85
    iterations: int = 20


@dataclasses.dataclass(frozen=True)
class SearchOptions:
    default_limit: int = 10
    max_limit: int = 50
    max_query_chars: int = 500
    alpha: float = 2.0
    snippet_window: int = 160


# The variables of the services' configuration, by field. Fields without one have no variable.
VARIABLES = {
    "max_depth": "MAX_DEPTH",
    "max_pages": "MAX_PAGES",
    "crawl_delay_sec": "DEFAULT_CRAWL_DELAY_SECONDS",
    "allow_offsite_links": "ALLOW_OFFSITE_LINKS",
    "worker_tasks": "NUM_WORKER_TASKS",
    "fetch_timeout_sec": "REQUEST_TIMEOUT_SECONDS",
    "visibility_timeout_ms": "VISIBILITY_TIMEOUT_MS",
    "rate_limit_sleep_sec": "RATE_LIMIT_RETRY_SLEEP_SECONDS",
    "bloom_bits": "BLOOM_SIZE_BITS",
    "bloom_hashes": "BLOOM_NUM_HASHES",
    "recrawl_hours": "RECRAWL_INTERVAL_HOURS",
    "max_retries": "MAX_RETRIES",
    "retry_base_sec": "RETRY_BASE_DELAY_SECONDS",
    "retry_cap_sec": "RETRY_MAX_DELAY_SECONDS",
    "retry_poll_sec": "RETRY_SCHEDULER_POLL_SECONDS",
    "batch_size": "INDEX_BATCH_SIZE",
    "poll_sec": "INDEX_POLL_INTERVAL_SECONDS",
    "pagerank_interval_sec": "PAGERANK_INTERVAL_SECONDS",
    "damping": "PAGERANK_DAMPING",
    "iterations": "PAGERANK_ITERATIONS",
    "default_limit": "DEFAULT_RESULT_LIMIT",
    "max_limit": "MAX_RESULT_LIMIT",
    "alpha": "PAGERANK_BOOST_ALPHA",
}


def from_env(kind: type, env: Mapping[str, str] | None = None):
    """An options object with what the environment gives; its streaming jobs take it where they are given none."""
    env = os.environ if env is None else env
    given = {}
    for f in dataclasses.fields(kind):
        if (raw := env.get(VARIABLES.get(f.name, ""))) is not None:
            made = type(f.default)
            given[f.name] = parse_bool(raw) if made is bool else made(raw)
    return kind(**given)
