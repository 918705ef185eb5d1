"""Requests to a paged service, as tasks make them: clients, typed errors and retries."""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol


class ServiceError(RuntimeError):
    """A request that wasn't answered as it should be."""


class Unauthorized(ServiceError):
    """Status 401: the session has ended; asking again doesn't help."""


class UnexpectedStatus(ServiceError):
    """Any status but 200 and 401, after the retries where these may help."""


class BadAnswer(ServiceError):
    """Status 200 with a body that isn't a page."""


class Client(Protocol):
    def get(self, path: str, query: dict[str, str]) -> tuple[int, str]:
        """Status and body; an OSError where there is no answer."""
        ...


class Http:
    """GET requests below the option ``url`` with the bearer ``token``; one session id for each client, and a number for each request."""

    def __init__(self, options: dict):
        self.url, self.token = options["url"], options.get("token", "")
        self.timeout, self.session = float(options.get("timeout_seconds", 60)), str(uuid.uuid4())

    def get(self, path: str, query: dict[str, str]) -> tuple[int, str]:
        info = {"clientRequestId": {"sessionId": self.session, "requestId": str(time.time_ns() // 1_000_000)[-9:]}}
        headers = {"Authorization": f"Bearer {self.token}", "Accept": "application/json", "Content-Type": "application/json", "x-http-request-info": json.dumps(info)}
        asked = f"{self.url}/{path}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
        try:
            with urllib.request.urlopen(urllib.request.Request(asked, headers=headers), timeout=self.timeout) as answer:  # noqa: S310
                return answer.status, answer.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(errors="replace")


def client_of(options: dict) -> Client:
    """What the option ``client`` ("module:factory", called with the options) gives; Http without one."""
    if "client" not in options:
        return Http(options)
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(options)


def may_pass(status: int) -> bool:
    """Whether the same request may be answered later: time-outs, too many requests, errors of the server."""
    return status in (408, 429) or 500 <= status < 600


class Service:
    """Pages of a client, each asked for again up to ``retries`` times, after ``wait_seconds``, twice that, ... at most nine times that."""

    def __init__(self, options: dict, sleep: Callable[[float], None] = time.sleep):
        self.client, self.sleep = client_of(options), sleep
        self.retries, self.wait = int(options.get("retries", 6)), float(options.get("wait_seconds", 60))

    def page(self, path: str, query: dict[str, str], offset: int) -> tuple[list, int]:
        """Values of the page that begins at ``offset``, and how many there are in all."""
        asked = {**query, "paging-first": str(offset)}
        for attempt in range(self.retries + 1):
            try:
                status, body = self.client.get(path, asked)
            except OSError:
                if attempt == self.retries:
                    raise
            else:
                if status == 200:
                    return self._decoded(path, body)
                if status == 401:
                    raise Unauthorized(f"{path}: the session has ended")
                if attempt == self.retries or not may_pass(status):
                    raise UnexpectedStatus(f"{path}: status {status}")
            self.sleep(min(self.wait * 2**attempt, 9 * self.wait))
        raise AssertionError("unreachable")

    @staticmethod
    def _decoded(path: str, body: str) -> tuple[list, int]:
        try:
            page = json.loads(body)
            values, matches = page["values"], page["paging"]["matches"]
        except (ValueError, TypeError, KeyError) as e:
            raise BadAnswer(f"{path}: {e!r}") from e
        if not isinstance(values, list) or not isinstance(matches, int):
            raise BadAnswer(f"{path}: no page")
        return values, matches

    def rows(self, path: str, query: dict[str, str], start: int, end: int) -> Iterator[tuple[int, list]]:
        """Place of the first value and values of the pages between two places; a page before the end without a value is an error."""
        at = start
        while at < end:
            values, _ = self.page(path, query, at)
            if not values:
                raise BadAnswer(f"{path}: nothing at {at} of {end}")
            yield at, values[: end - at]
            at += len(values)


def offsets(first_page: int, matches: int) -> list[int]:
    """Where pages begin: none without rows, else every first_page-th row."""
    return list(range(0, matches, first_page)) if first_page > 0 else []
