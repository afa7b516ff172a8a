"""Inference that can be stopped or killed at any time, and goes on where it was.

Requests are staged once as files of a few rows.  A stream takes some files per batch, asks the model
and writes the answers under the number of the batch.  A batch counts when it is written as a whole;
a lost executor, driver or machine costs the calls of one batch at most.  Requests are known by
report and digest, so a later run stages only what is new or has changed.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inference import RateLimited, Rejected, request_json
from .intake import BATCH

STAGED_SCHEMA = "report string, request string, messages string"
COMMITTED_SCHEMA = "report string, request string, response string, status string, error string, attempts int"
_KEY = ["report", "request"]


@dataclass(frozen=True)
class Pace:
    """How often to try and how long to wait; ``per_minute`` bounds the calls of one task."""

    attempts: int = 5
    wait: float = 60.0
    longest: float = 900.0
    per_minute: float | None = None

    def delay(self, attempt: int, request: str) -> float:
        """Doubles with each attempt; the request decides on a part of it, so that tasks do not return all at once."""
        share = int.from_bytes(hashlib.sha256(f"{request}:{attempt}".encode()).digest()[:4], "big") / 0xFFFFFFFF
        return min(self.longest, self.wait * 2 ** (attempt - 1)) * (0.5 + share / 2)


class Budget:
    """Lets calls through at even distances."""

    def __init__(self, per_minute: float | None, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.gap, self.clock, self.sleep, self.free_at = 60.0 / per_minute if per_minute else 0.0, clock, sleep, clock()

    def take(self) -> None:
        now = self.clock()
        if self.free_at > now:
            self.sleep(self.free_at - now)
        self.free_at = max(now, self.free_at) + self.gap


def ask(client, request: str, messages: str, pace: Pace, budget: Budget, sleep: Callable[[float], None]) -> tuple:
    """``(response, status, error, attempts)`` of one request."""
    reason = None
    for attempt in range(1, pace.attempts + 1):
        budget.take()
        try:
            return client(messages), "ok", None, attempt
        except RateLimited as error:
            reason = str(error)
            if attempt < pace.attempts:
                sleep(pace.delay(attempt, request))
        except Rejected as error:
            return None, "rejected", str(error), attempt
        except Exception as error:  # the row is kept with its error, the job goes on
            return None, "failed", f"{type(error).__name__}: {error}", attempt
    return None, "rate_limited", reason, pace.attempts


def _answers(staged: DataFrame, client_factory, pace: Pace, clock, sleep) -> DataFrame:
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, budget = client_factory(), Budget(pace.per_minute, clock, sleep)
        for batch in batches:
            rows = [
                (report, request, *ask(client, request, messages, pace, budget, sleep))
                for report, request, messages in zip(batch["report"], batch["request"], batch["messages"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=[*_KEY, "response", "status", "error", "attempts"])

    return staged.mapInPandas(call, COMMITTED_SCHEMA)


def stage_requests(requests: DataFrame, path: str, per_file: int = 20, again: DataFrame | None = None) -> None:
    """Write those requests ``(report, messages)`` that have not been staged yet, ``per_file`` at most to a file.

    ``again`` holds keys ``(report, request)`` to stage once more.
    """
    spark, folder = requests.sparkSession, f"{path}/requests"
    payload = requests.select("report", request_json(F.col("messages")).alias("messages"))
    keyed = payload.select("report", F.sha2("messages", 256).alias("request"), "messages")
    # The folder is there from the first run on, also without requests.
    spark.createDataFrame([], STAGED_SCHEMA).write.mode("append").parquet(folder)
    known = spark.read.schema(STAGED_SCHEMA).parquet(folder).select(*_KEY).distinct()
    if again is not None:
        known = known.join(again, _KEY, "left_anti")
    keyed.join(known, _KEY, "left_anti").write.mode("append").option("maxRecordsPerFile", per_file).parquet(folder)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``(report, request, response, status, error, attempts, batch)``: the last answer to each request."""
    # The folder is there from the first run on, also without answers.
    spark.createDataFrame([], COMMITTED_SCHEMA).write.mode("overwrite").parquet(f"{path}/answers/{BATCH}=-1")
    rows = spark.read.schema(f"{COMMITTED_SCHEMA}, {BATCH} long").parquet(f"{path}/answers")
    values = [c for c in rows.columns if c not in _KEY]
    last = F.max_by(F.struct(*values), F.col(BATCH)).alias("last")
    return rows.groupBy(*_KEY).agg(last).select(*_KEY, "last.*")


def infer_restartable(
    requests: DataFrame,
    client_factory: Callable[[], Callable[[str], str]],
    path: str,
    pace: Pace = Pace(),
    per_file: int = 20,
    files_per_batch: int = 8,
    ask_failed_again: bool = False,
    on_batch: Callable[[int], None] | None = None,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Answers to all requests, those of earlier runs below ``path`` included; see :func:`committed`.

    Call it again with the same ``path`` after a run that ended early: requests that have been answered are not
    sent again.  Requests of a report that have changed are new ones.  With ``ask_failed_again``, those
    that were not answered are sent once more, and their last outcome counts.  As many calls are made at a time as
    a batch has files and the cluster cores.  ``on_batch`` is called with the number of each batch after its answers
    are written and before it counts; what it raises ends the run.
    """
    spark = requests.sparkSession
    again = committed(spark, path).where("status <> 'ok'").select(*_KEY) if ask_failed_again else None
    stage_requests(requests, path, per_file, again)

    def write(batch: DataFrame, number: int) -> None:
        _answers(batch, client_factory, pace, clock, sleep).write.mode("overwrite").parquet(f"{path}/answers/{BATCH}={number}")
        if on_batch:
            on_batch(number)

    files = spark.readStream.schema(STAGED_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/requests")
    stream = (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return committed(spark, path)
