"""The import as a job of its own: ``python -m ledgerlake.streaming.job``, with settings from APP_ variables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..plans.store import Snapshots
from ..sources.service import Unauthorized
from ..sources.settings import Settings, from_environment, reader_options
from .ingest import import_all
from .schedule import run_every


def unauthorized(error: BaseException) -> bool:
    """Whether a job ended because the service asks for a new session; the error may come from a task."""
    return isinstance(error, Unauthorized) or Unauthorized.__name__ in str(error)


class SessionEnded(RuntimeError):
    """Trying again doesn't help: somebody has to log in."""


def import_loop(spark: SparkSession, settings: Settings, **loop) -> int:
    """Whole imports, each ``delay_seconds`` after the last has ended; how many ended well. Further arguments are those of run_every."""
    store = Snapshots(spark, settings.store)

    def once() -> None:
        try:
            import_all(spark, reader_options(settings.bank), store, settings.institute)
        except Exception as e:
            if unauthorized(e):
                raise SessionEnded("the service asks for a new session") from e
            raise

    return run_every(once, delay=settings.delay_seconds, fatal=(SessionEnded,), **loop)


def main(build: Callable[[], SparkSession] = SparkSession.builder.getOrCreate) -> None:
    settings = from_environment(Settings)
    import_loop(build(), settings)


if __name__ == "__main__":
    main()
