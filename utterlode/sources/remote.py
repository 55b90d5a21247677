"""Requests to services that embed or chat: settings from the environment, JSON over HTTP, retries."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable

#: Replies after which a request is worth another attempt.
PASSING = frozenset({429, 500, 502, 503, 504})


def required_env(prefix: str, names: tuple[str, ...], error: type[Exception]) -> list[str]:
    """The settings ``<prefix>_<NAME>``; an error names those that are not set."""
    values = {f"{prefix}_{n.upper()}": os.environ.get(f"{prefix}_{n.upper()}", "").strip() for n in names}
    if absent := [n for n, v in values.items() if not v]:
        raise error(f"{', '.join(absent)} must be set")
    return [v.rstrip("/") if n.endswith("_URL") else v for n, v in values.items()]


def retried(call: Callable[[], dict], error: type[Exception], attempts: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """What ``call`` returns; failures that may pass are tried again after 2, 4, 8 ... seconds."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except urllib.error.HTTPError as failure:
            if failure.code not in PASSING or attempt == attempts:
                raise error(f"the request failed: HTTP {failure.code} {failure.read()[:300].decode(errors='replace')}") from failure
        except (urllib.error.URLError, TimeoutError) as failure:
            if attempt == attempts:
                raise error(f"the request failed: {failure}") from failure
        sleep(2.0**attempt)
    raise error("no attempt was made")


def post_json(url: str, key: str, body: dict, error: type[Exception], attempts: int, timeout: float) -> dict:
    """The JSON reply to ``body``."""

    def call() -> dict:
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
            return json.load(reply)

    return retried(call, error, attempts)
