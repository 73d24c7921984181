"""Policies of a web client for fetching wiki tables: retries, request budget, paging, host checks, and the run hook.

The engine itself reads tables. A fetch job on the driver puts these around any ``send`` callable; executors share no
request budget, so fetching is not distributed.
"""

from __future__ import annotations

import random
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

from wikiloom.sources.config import hook_command

#: Statuses after which a request is tried again.
RETRY_STATUSES = frozenset({429, 500, 502, 503, 504})
MAX_DOUBLINGS = 10
ERROR_BODY_BYTES = 1024


@dataclass
class Response:
    status: int
    body: dict | list | None = None
    headers: dict[str, str] = field(default_factory=dict)
    text: str = ""


class HttpError(RuntimeError):
    """A status that is no success; the start of the body goes into the message."""

    def __init__(self, status: int, text: str = ""):
        self.status = status
        super().__init__(f"status {status}: {text.encode()[:ERROR_BODY_BYTES].decode(errors='ignore')}")


class NotFound(HttpError):
    pass


def retry_after(value: str | None, now: float | None = None) -> float:
    """Seconds of a Retry-After header, given as seconds or as a date; 0 where it is neither or past."""
    text = (value or "").strip()
    if text.isdigit():
        return float(text)
    try:
        return max(0.0, parsedate_to_datetime(text).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return 0.0


def retry_delay(attempt: int, first_ms: int, response: Response | None = None, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt (attempts count from 0): what a 429 asks for, else doubling, ten per cent around."""
    if response is not None and response.status == 429 and (asked := retry_after(response.headers.get("Retry-After"))) > 0:
        return asked
    return first_ms / 1000 * 2 ** min(attempt, MAX_DOUBLINGS) * (0.9 + 0.2 * jitter())


class TokenBucket:
    """A request budget per minute with a burst; ``take`` waits until a request may go out."""

    def __init__(self, per_minute: int, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = per_minute / 60, float(max(1, burst)), clock, sleep
        self.tokens, self.at, self.lock = self.burst, clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
            self.at = now
            wait = -self.tokens / self.rate if self.tokens < 0 else 0.0
        if wait:
            self.sleep(wait)


def same_host(a: str, b: str) -> bool:
    """Whether two URLs have the same host and port; credentials go to the same host only."""
    x, y = urlsplit(a), urlsplit(b)
    return bool(x.netloc) and x.netloc.lower() == y.netloc.lower()


def next_url(base: str, link: str | None) -> str | None:
    """Absolute address of a next-page link; None where there is none."""
    return urljoin(base.rstrip("/") + "/", link) if link else None


class Client:
    """JSON requests with retries, budget and paging. ``send(url, with_credentials)`` does the transport."""

    def __init__(self, base_url: str, send: Callable[[str, bool], Response], attempts: int = 5, first_ms: int = 1000, bucket: TokenBucket | None = None, sleep: Callable[[float], None] = time.sleep):
        self.base_url, self.send, self.attempts, self.first_ms, self.bucket, self.sleep = base_url, send, attempts, first_ms, bucket, sleep

    def get(self, url: str) -> Response:
        home = same_host(url, self.base_url)
        for attempt in range(self.attempts):
            if self.bucket and home:
                self.bucket.take()
            response, failure = None, None
            try:
                response = self.send(url, home)
            except OSError as e:
                failure = e
            if response is not None and response.status not in RETRY_STATUSES:
                break
            if attempt + 1 < self.attempts:
                self.sleep(retry_delay(attempt, self.first_ms, response))
            elif failure:
                raise failure
        if response.status == 404:
            raise NotFound(404, response.text)
        if not 200 <= response.status < 300:
            raise HttpError(response.status, response.text)
        return response

    def pages(self, url: str) -> Iterator[dict]:
        """Results of all pages of a listing, following ``_links.next``; a listing that is gone ends."""
        at: str | None = url
        seen = set()
        while at and at not in seen:
            seen.add(at)
            try:
                body = self.get(at).body or {}
            except NotFound:
                return
            yield from body.get("results") or ()
            at = next_url(self.base_url, (body.get("_links") or {}).get("next"))


def run_hook(argv: list[str], dry_run: bool = False) -> subprocess.Popen | None:
    """Start the command that follows a run, without waiting for it; nothing in a dry run or without a command."""
    command = hook_command(argv)
    if dry_run or not command:
        return None
    return subprocess.Popen(command, stdin=subprocess.DEVNULL, start_new_session=True)
