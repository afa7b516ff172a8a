"""Counts of a run, taken by the pass that writes it.

Reports that were processed, included and dropped, and those in which a field was not found,
are observed on their way from the reader to the writer: nothing is read or computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.writers import write_structured
from .structure import Hook, missing_fields, structure


class RunCounts:
    """Two points of observation; the counts are there once the rows have been written."""

    def __init__(self) -> None:
        self._processed, self._included = Observation(), Observation()

    def processed(self, responses: DataFrame, response: str = "response") -> DataFrame:
        """Every report that is read, and those without a response."""
        return responses.observe(
            self._processed,
            F.count(F.lit(1)).alias("processed"),
            F.count_if(F.col(response).isNull()).alias("without_response"),
        )

    def included(self, structured: DataFrame) -> DataFrame:
        """Every row that is written, and those in which a field was not found."""
        return structured.observe(
            self._included,
            F.count(F.lit(1)).alias("included"),
            *[F.count_if(test).alias(name) for name, test in missing_fields().items()],
        )

    def counts(self) -> dict[str, int]:
        """Waits for the first write of the observed rows."""
        before, after = self._processed.get, self._included.get
        return {**before, "dropped": before["processed"] - after["included"], **after}


def write_run(
    responses: DataFrame,
    path: str,
    clean: Hook | None = None,
    keep: Hook | None = None,
    format: str = "parquet",
    response: str = "response",
) -> dict[str, int]:
    """Structure responses, write the table, and return the counts of the same pass.

    ``processed`` counts rows after ``clean`` and before ``keep``; ``dropped`` are those that ``keep`` took out.
    Rows of a task that is run again count once, as long as its stage is not repeated as a whole.
    """
    run = RunCounts()
    read = run.processed(responses.transform(clean) if clean else responses, response)
    write_structured(run.included(structure(read, keep=keep, response=response)), path, format)
    return run.counts()
