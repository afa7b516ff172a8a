"""From report pages to answers: request building and batch inference.

The model is reached through a client made once per task by a factory that the
caller passes in.  Everything before and after the call is plain columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_URL_PREFIX = "data:image/png;base64,"
ANSWERS_SCHEMA = "report string, response string, status string, error string, attempts int"


class RateLimited(Exception):
    """The service asks to wait; the request is tried again."""


class Rejected(Exception):
    """The service refuses this request for good, or refuses the credentials."""


def base64_text(content: Column) -> Column:
    """Base64 without line breaks, whatever the session setting for chunks."""
    return F.translate(F.base64(content), "\r\n", "")


def assemble_pages(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(report, pages)`` from ``(report, page_no, content)``, pages in order.

    ``tasks`` is the number of tasks that reports are dealt to, and with that the most
    calls that :func:`infer` makes at a time.  A request holds all pages of its report, so one row per report is inherent;
    the pages of one report must fit in one request anyway.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "content")))
    dealt = pages.repartition(tasks, "report") if tasks else pages
    return dealt.groupBy("report").agg(ordered.alias("pages"))


def _part(kind: str, text: Column | None = None, url: Column | None = None, detail: str = "high") -> Column:
    image = F.struct(
        (url if url is not None else F.lit(None).cast("string")).alias("url"),
        F.lit(detail).alias("detail"),
    )
    return F.struct(
        F.lit(kind).alias("type"),
        (text if text is not None else F.lit(None).cast("string")).alias("text"),
        (image if url is not None else F.lit(None).cast(_IMAGE_TYPE)).alias("image_url"),
    )


_IMAGE_TYPE = "struct<url: string, detail: string>"


def build_requests(pages: DataFrame, prompt: str | Column, detail: str = "high") -> DataFrame:
    """``(report, messages)`` from assembled pages: the prompt, then one image per page.

    The payload is built from binary pages here and nowhere before, so nothing
    larger than the pages is exchanged.
    """
    text = prompt if isinstance(prompt, Column) else F.lit(prompt)

    def image(page: Column) -> Column:
        url = F.concat(F.lit(IMAGE_URL_PREFIX), base64_text(page["content"]))
        return _part("image_url", url=url, detail=detail)

    content = F.concat(F.array(_part("text", text=text)), F.transform("pages", image))
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    return pages.select("report", F.array(message).alias("messages"))


def request_json(messages: Column) -> Column:
    """Messages as the JSON text of a chat request; absent fields are left out."""
    return F.to_json(messages)


def _answer(client, messages: str, max_attempts: int, wait: float, sleep) -> tuple:
    for attempt in range(1, max_attempts + 1):
        try:
            return client(messages), "ok", None, attempt
        except RateLimited as error:
            status, reason = "rate_limited", str(error)
            if attempt < max_attempts:
                sleep(wait)
        except Rejected as error:
            return None, "rejected", str(error), attempt
        except Exception as error:  # the row is kept with its error, the job goes on
            return None, "failed", f"{type(error).__name__}: {error}", attempt
    return None, status, reason, max_attempts


def infer(
    requests: DataFrame,
    client_factory: Callable[[], Callable[[str], str]],
    max_attempts: int = 5,
    wait: float = 60.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """One call per request: ``(report, response, status, error, attempts)``.

    ``client_factory`` returns a function from the JSON text of the messages to the
    answer.  It may raise :class:`RateLimited` (wait, then try again, at most
    ``max_attempts`` times) or :class:`Rejected`; any other error is kept in the
    row as ``failed``.  There are as many simultaneous calls as tasks: see
    :func:`assemble_pages`, as after it the payload is no longer to be exchanged.

    Requests reach a task in batches of bounded size
    (``spark.sql.execution.arrow.maxBytesPerBatch``).  Write the result before using
    it: every action on an unwritten one would call the model again.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for batch in batches:
            rows = [
                (report, *_answer(client, messages, max_attempts, wait, sleep))
                for report, messages in zip(batch["report"], batch["messages"])
            ]
            yield pd.DataFrame(rows, columns=["report", "response", "status", "error", "attempts"])

    ready = requests.select("report", request_json(F.col("messages")).alias("messages"))
    return ready.mapInPandas(call, ANSWERS_SCHEMA)


def answered(answers: DataFrame) -> DataFrame:
    """``(report, response)`` of the answered requests; the others stay in the answers table."""
    return answers.where(F.col("status") == "ok").select("report", "response")


def failed(answers: DataFrame) -> DataFrame:
    """Requests without an answer, with the reason."""
    return answers.where(F.col("status") != "ok").select("report", "status", "error", "attempts")


def append(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several tables, by column name."""
    for other in others:
        first = first.unionByName(other)
    return first
