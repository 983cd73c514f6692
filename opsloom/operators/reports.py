"""What one call of the service asks for: the queries of a report over one window, and the named CSV exports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.window import Window
from ..sources.sinks import write_csv
from ..sources.tables import Sources
from . import documents, logs
from .cache import ResultCache, asked
from .rollup import Rollup, counted


class NotFound(LookupError):
    """There is no such conversation."""


class Gone(LookupError):
    """The export is no longer offered."""


REPORTS = {
    "overview": {"overview": logs.overview, "usage": documents.usage},
    "usage": {"series": logs.usage, "usage": documents.usage},
    "errors": {"trend": logs.error_trend, "endpoints": logs.top_endpoints, "types": logs.top_errors},
    "devices": {"devices": logs.devices},
    "query_suggest": {"stages": logs.suggest_stages, "fallbacks": logs.suggest_fallbacks, "facts": documents.suggestion_funnel},
}
REPORTS["dashboard"] = {
    "overview": logs.overview, "series": logs.usage, "error_trend": logs.error_trend, "endpoints": logs.top_endpoints, "errors": logs.top_errors, "devices": logs.devices,
    "monitor": documents.monitor, "users": documents.dashboard_users, "summary": documents.dashboard_summary,
}


def _asked(f, log):
    """A part's function, with what the logs say taken from ``log``."""
    if f.__module__ == logs.__name__:
        return getattr(log, f.__name__)
    return partial(f, log=log) if f in (documents.dashboard_users, documents.dashboard_summary) else f


def report(src: Sources, w: Window, name: str, log=logs) -> dict[str, DataFrame]:
    """The parts of a report by name; what the logs say comes from ``log``: the module that reads them, or a rollup."""
    return {part: _asked(f, log)(src, w) for part, f in REPORTS[name].items()}


def dashboard(src: Sources, w: Window, user: str = "", log=logs, cache: ResultCache | None = None) -> dict[str, DataFrame]:
    """The dashboard's parts; with a user to look for also that user's row and request series (no rows if there is no such
    user or no request). With a cache a call that was made lately gives what it gave."""

    def parts() -> dict[str, DataFrame]:
        found = report(src, w, "dashboard", log)
        if user.strip():
            found |= {"selected_user": documents.selected_user(src, w, user, log), "selected_series": documents.selected_series(src, w, user, log)}
        return found

    return parts() if cache is None else cache.get(asked(w, "dashboard", user), parts)


#: How many rows a listing may be asked for.
LIMITS = {"users": (documents.list_users, 500), "conversations": (documents.list_conversations, 500), "messages": (documents.messages, 2000)}


def listing(src: Sources, name: str, *args: str, limit: int, **more) -> DataFrame:
    """A listing of users, of a user's conversations or of a conversation's messages; a limit out of bounds is refused."""
    f, most = LIMITS[name]
    if not 1 <= limit <= most:
        raise ValueError(f"limit of {name}: {limit} is not between 1 and {most}")
    return f(src, *args, limit=limit, **more)


@contextmanager
def shared(src: Sources, w: Window) -> Iterator[Sources]:
    """The same sources with the logs of the window read once for all that is asked inside (kept by the executors, in
    memory or on disk; a lost part is read again)."""
    inside = lambda t: t.where((F.col("timestamp") >= F.lit(w.start)) & (F.col("timestamp") < F.lit(w.end))).persist()
    kept = {n: inside(getattr(src, n)) for n in ("requests", "stdout", "stderr")}
    try:
        yield Sources(**kept, **{n: (lambda n=n: getattr(src, n)) for n in ("users", "conversations", "messages", "summaries", "runtime")})
    finally:
        for t in kept.values():
            t.unpersist()


@contextmanager
def summed(src: Sources, w: Window) -> Iterator[Rollup]:
    """A rollup of the logs of the window, for which each log is read once, by five-minute steps and so far smaller than
    the entries (kept by the executors, in memory or on disk; a lost part is counted again)."""
    kept = {n: t.persist() for n, t in counted(src, [(w.start, w.end)]).items()}
    try:
        yield Rollup(**kept)
    finally:
        for t in kept.values():
            t.unpersist()


def drill_down(src: Sources, user: str, conv: str) -> tuple[DataFrame, DataFrame]:
    """Header and messages of a conversation; ``NotFound`` if there is none (reads one row to know)."""
    head = documents.conversation(src, user, conv)
    if head.isEmpty():
        raise NotFound(f"{user}/{conv}")
    return head, documents.messages(src, user, conv)


EXPORTS = {
    "usage": logs.usage, "errors/trend": logs.error_trend, "errors/endpoints": logs.top_endpoints, "errors/types": logs.top_errors, "devices": logs.devices,
    "query-suggest/stages": logs.suggest_stages, "query-suggest/fallbacks": logs.suggest_fallbacks, "query-suggest/facts": documents.suggestion_funnel,
}


def export(src: Sources, name: str, path: str, w: Window | None = None, user: str | None = None, conv: str | None = None, write=write_csv) -> None:
    """Write a named export as CSV files: by window, or ``users`` (one user's messages) and ``conversations`` (one
    conversation's). ``messages`` is gone. ``write`` may be ``sinks.write_csv_whole`` for one header over all files."""
    if name == "messages":
        raise Gone(name)
    if name in ("users", "conversations"):
        write(documents.export_messages(src, user or "", None if name == "users" else conv or ""), path)
    elif name in EXPORTS:
        write(EXPORTS[name](src, w), path)
    else:
        raise KeyError(name)
