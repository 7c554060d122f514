"""Search functions as table functions: a caller's function gives rows for a query, and any number of them is joined laterally to a column of queries."""

from __future__ import annotations

import contextlib
import signal
import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a function may give, with the types that its rows are brought to.
RESULT = "url string, title string, artist string, album string, duration double, error string"
#: Seconds that one query may take.
SECONDS = 12.0


@contextlib.contextmanager
def limited(seconds: float):
    """Raises TimeoutError inside once the time is up. Where a task doesn't run in its process's main thread there is no limit."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError("timed out")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def search_function(name: str, search: Callable[[str], Iterable[dict]], seconds: float = SECONDS):
    """A table function of a search: a row for each result with an address, artist and album filled by the function's name where they lack. A search that
    raises or takes too long gives what it gave before, and a row with its error; the other queries and functions are not touched by it. A null query gives nothing."""
    class Search:
        def eval(self, query: str):
            if query is None:
                return
            rows, error = [], None
            try:
                with limited(seconds):
                    for r in search(query):
                        if r and r.get("url"):
                            rows.append((str(r["url"]), r.get("title"), r.get("artist") or name, r.get("album") or name, float(r.get("duration") or 0), None))
            except Exception as x:  # the caller's code: whatever it raises is its result
                error = str(x) or type(x).__name__
            yield from rows
            if error is not None:
                yield (None, None, None, None, None, error)

    return F.udtf(Search, returnType=RESULT)


def searched(queries: DataFrame, column: str, functions: dict) -> DataFrame:
    """The queries beside what each function finds for them: their columns, function, and the columns of RESULT. A query without results has no row."""
    out = None
    for name, function in functions.items():
        found = queries.lateralJoin(function(F.col(column).outer()).select(F.lit(name).alias("function"), "*"))
        out = found if out is None else out.unionByName(found)
    return out
