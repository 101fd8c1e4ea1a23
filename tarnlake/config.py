"""Settings: the numbers that change results, with their defaults, read once from TARNLAKE_* of the environment.

``SETTINGS`` gives the default arguments of the operators; an argument given to a call wins.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 200
    chunk_overlap: int = 50
    cache_version: int = 1
    max_context_items: int = 5
    retrieval_k: int = 10
    dense_weight: float = 0.5
    rrf_c: int = 60
    max_critique_attempts: int = 2
    max_rewrite_attempts: int = 3
    retry_attempts: int = 3
    retry_delay: float = 1.0
    web_hosts: tuple[str, ...] = ("epid.gov.lk", "health.gov.lk")
    web_results: int = 5
    max_input_length: int = 2000
    page_size: int = 25
    stats_cap: int | None = 5000
    keyword_cap: int | None = 1000
    export_cap: int = 10_000
    top_keywords: int = 30
    min_link_weight: int = 2
    excerpt_length: int = 200

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "TARNLAKE_") -> Settings:
        """From text values such as an environment's. Blank ones keep the default; "none" is no cap."""
        found = {}
        for f in fields(cls):
            text = (values.get(prefix + f.name.upper()) or "").strip()
            if text:
                found[f.name] = _typed(text, getattr(cls, f.name))
        return cls(**found)


def _typed(text: str, default: object) -> object:
    if text.lower() == "none":
        return None
    if isinstance(default, tuple):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    if isinstance(default, bool):
        return flag(text)
    return (float if isinstance(default, float) else int)(text)


def flag(text: str | None, default: bool = False) -> bool:
    return default if text is None or not text.strip() else text.strip().lower() in ("1", "true", "yes", "on")


SETTINGS = Settings.read(os.environ)
