"""Jobs again and again, each some time after the last one has ended."""

from __future__ import annotations

import time
from collections.abc import Callable

#: Seconds between two imports, and failures in a row that end the loop.
DELAY, ATTEMPTS = 4 * 3600.0, 6


def backoff_seconds(attempt: int) -> float:
    """10, 20 and 40 minutes after the first failures, then 60."""
    return 60.0 * min(10 * 2 ** min(attempt - 1, 3), 60)


def run_every(
    job: Callable[[], object], delay: float = DELAY, attempts: int = ATTEMPTS, rounds: int | None = None, until: Callable[[], bool] = lambda: False, fatal: tuple[type[BaseException], ...] = (), clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> int:
    """The job at once, and then ``delay`` seconds after it has ended, so that runs never overlap; how often it ended well.

    After a failure it is tried again, later each time (``backoff_seconds``); after ``attempts`` failures in
    a row, or one of the ``fatal`` kind, the error is raised. The loop ends after ``rounds`` runs that ended
    well, or when ``until`` says so before a run.
    """
    well, failed = 0, 0
    while (rounds is None or well < rounds) and not until():
        try:
            job()
        except fatal:
            raise
        except Exception:
            failed += 1
            if failed >= attempts:
                raise
            due = clock() + backoff_seconds(failed)
        else:
            well, failed = well + 1, 0
            due = clock() + delay
        if rounds is None or well < rounds:
            while (left := due - clock()) > 0 and not until():
                sleep(min(left, 60.0))
    return well
