"""Retries for calls to services outside Spark; tasks have Spark's own."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from tarnlake.config import SETTINGS

T = TypeVar("T")


def retry(attempts: int = SETTINGS.retry_attempts, delay: float = SETTINGS.retry_delay, on: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """Call again after ``delay``, which doubles each time; the last error is raised."""

    def wrap(f: Callable[..., T]) -> Callable[..., T]:
        @wraps(f)
        def call(*args, **kwargs) -> T:
            wait = delay
            for left in range(attempts - 1, -1, -1):
                try:
                    return f(*args, **kwargs)
                except on:
                    if not left:
                        raise
                    sleep(wait)
                    wait *= 2
            raise ValueError("attempts must be positive")

        return call

    return wrap
