"""The life of audit tasks, as keyed state over a stream of events.

Events of a task (task_id, event_no, kind, path, error) are taken in the order of event_no; what may follow on what is a table,
``TRANSITIONS``. An event that does not fit the task's status (a result that comes after a cancellation, say) is told as
not accepted and changes nothing. The state is one row for each task: status, number of the last event, path and error. Events with
a number not above the last one have been seen before and are passed over, so a source that repeats itself does no harm.

Within a micro-batch events may come in any order; from batch to batch they come in order.

Defined cases: null statuses do not occur: a task begins with ``submit``; events without a number are not accepted; kinds that
the table does not know are not accepted; of two events with one number the first in the order of kind counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed values: (status, kind of event) to the status that follows; an empty status is a task not yet known.
TRANSITIONS = {
    ("", "submit"): "PENDING",
    ("PENDING", "start"): "RUNNING",
    ("RUNNING", "pause"): "PAUSED",
    ("PAUSED", "resume"): "RUNNING",
    ("RUNNING", "done"): "REVIEW_PENDING",
    ("RUNNING", "fail"): "FAILED",
    ("REVIEW_PENDING", "approve"): "COMPLETED",
    ("FAILED", "submit"): "PENDING",
    ("CANCELLED", "submit"): "PENDING",
    ("PENDING", "cancel"): "CANCELLED",
    ("RUNNING", "cancel"): "CANCELLED",
    ("PAUSED", "cancel"): "CANCELLED",
}
EVENT = "task_id long, event_no long, kind string, path string, error string"
STEP = "task_id long, event_no long, kind string, status string, accepted boolean, path string, error string"


class Tasks(StatefulProcessor):
    def __init__(self, transitions: Mapping[tuple[str, str], str]) -> None:
        self.transitions = dict(transitions)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", "status string, event_no long, path string, error string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last, path, error = self.task.get() or ("", -1, "", "")
        steps = []
        for no, kind, p, e in pd.concat(list(rows)).sort_values(["event_no", "kind"])[["event_no", "kind", "path", "error"]].itertuples(index=False):
            no = -1 if no != no else int(no)
            if 0 <= no <= last:
                continue
            after = self.transitions.get((status, kind)) if no >= 0 else None
            if after:
                status, path, error = after, p or "", e or ""
            last = max(last, no)
            steps.append((key[0], no, kind, status, after is not None, path, error))
        self.task.update((status, last, path, error))
        yield pd.DataFrame(steps, columns=["task_id", "event_no", "kind", "status", "accepted", "path", "error"])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, table: Mapping[tuple[str, str], str] = TRANSITIONS) -> DataFrame:
    """Every event of the stream with the status that holds after it, and whether it was accepted. Start within
    ``cache.keyed_state``."""
    rows = events.select(F.col("task_id").cast("long").alias("task_id"), F.col("event_no").cast("long").alias("event_no"), "kind", "path", "error")
    return rows.groupBy("task_id").transformWithStateInPandas(Tasks(table), STEP, "Append", "None")


def latest(steps: DataFrame) -> DataFrame:
    """(task_id, status, path, error) after the last step of each task."""
    last = F.max_by(F.struct("status", "path", "error"), F.struct("event_no", "kind"))
    return steps.groupBy("task_id").agg(last.alias("x")).select("task_id", "x.*")


def outcomes(docs: DataFrame, failed: DataFrame, key: str, no: int, path: Column) -> DataFrame:
    """The events that an audit gives: ``fail`` with the error for documents in ``failed`` (key, error), else ``done``."""
    errors = failed.groupBy(F.col(key).alias("__k")).agg(F.min("error").alias("error"))
    rows = docs.select(F.col(key).alias("task_id"), path.alias("path")).distinct()
    rows = rows.join(errors, F.col("task_id") == F.col("__k"), "left")
    return rows.select("task_id", F.lit(no).cast("long").alias("event_no"), F.when(F.col("error").isNull(), "done").otherwise("fail").alias("kind"), F.when(F.col("error").isNull(), F.col("path")).alias("path"), "error")
