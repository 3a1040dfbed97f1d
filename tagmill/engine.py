"""One entry for clients: text in, response out."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import SparkSession

from tagmill.lang.tokens import CommandError
from tagmill.lang.validate import read
from tagmill.operators.commands import Result, run_events, run_index, run_query
from tagmill.sources.lines import text_lines
from tagmill.sources.store import EventStore, now_ms


#: EVENTs that one call may hand over; more are refused, and clients try again.
QUEUE = 131_072
_BUSY = "Rate limit error, please try again"


class Engine:
    """Commands against an event store. EVENTs given together are stored together; load() and streams are for bulk."""

    def __init__(self, spark: SparkSession, root: str, queue: int = QUEUE):
        self.spark, self.store, self.queue = spark, EventStore(spark, root), queue
        self._batch = (f"{uuid.uuid4().hex[:12]}-{n}" for n in itertools.count())

    def execute(self, text: str, arrival: int | None = None) -> Result:
        try:
            command = read(text.rstrip("\r\n"))
            if command.kind == "query":
                return run_query(self.store, command)
            if command.kind == "index":
                return run_index(self.store, command)
            return run_events(self.store, [text], next(self._batch), arrival)
        except CommandError as e:
            return Result(error=str(e))

    def execute_all(self, lines: list[str], arrival: int | None = None) -> list[Result]:
        """Pipelined commands, in order; runs of EVENTs become one batch."""
        out: list[Result] = []
        for is_event, group in itertools.groupby(lines, key=lambda x: x.split(maxsplit=1)[:1] and x.split(maxsplit=1)[0].lower() == "event"):
            some = list(group)
            if not is_event:
                out += [self.execute(x) for x in some]
                continue
            checked = [self._refusal(x) if k < self.queue else _BUSY for k, x in enumerate(some)]
            good = [x for x, e in zip(some, checked, strict=True) if e is None]
            if good:
                run_events(self.store, good, next(self._batch), arrival)
            out += [Result(error=e) for e in checked]
        return out

    @staticmethod
    def _refusal(line: str) -> str | None:
        try:
            read(line.rstrip("\r\n"))
        except CommandError as e:
            return str(e)
        return None

    def load(self, path: str, arrival: int | None = None) -> int:
        """Ingest text files of EVENT lines; the number of refused lines."""
        lines = text_lines(self.spark, path, now_ms() if arrival is None else arrival)
        return self.store.append(lines, next(self._batch)).count()
