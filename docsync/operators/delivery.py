"""Outcomes of deliveries, read from logs of attempts and polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.operators.skew import run_lag


def delivery_outcome(attempts: DataFrame, max_attempts: int = C.MAX_ATTEMPTS) -> DataFrame:
    """Outcome of each request. 2xx is success; 4xx other than 429 fails at once; a
    network error (null code) or any other code is tried again; the third failure
    exhausts the request and fewer leave it pending.

    With a `body_ok` column, a 2xx whose body could not be read fails at once. Calls that
    are never retried, such as the catalogue, have `max_attempts=1`.

    The rank filter keeps at most three rows per request and task before the shuffle,
    so a request with any number of rows stays small.
    """
    order = Window.partitionBy("request_id").orderBy("seq")
    code = F.col("code")
    readable = F.coalesce("body_ok", F.lit(True)) if "body_ok" in attempts.columns else F.lit(True)
    verdict = (
        F.when(code.between(200, 299) & F.col("readable"), "success")
        .when(code.between(200, 299), "fail_fast")
        .when(code.between(400, 499) & (code != 429), "fail_fast")
    )
    final_n = F.when(F.col("verdict").isNotNull(), F.col("n"))
    return (
        attempts.select(
            "request_id", "seq", F.col("code").cast("bigint").alias("code"), readable.alias("readable")
        )
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= max_attempts)
        .withColumn("verdict", verdict)
        .groupBy("request_id")
        .agg(
            F.count("*").alias("_logged"),
            F.min(final_n).cast("bigint").alias("_final_n"),
            F.min_by("verdict", final_n).alias("_verdict"),
            F.min_by("code", final_n).alias("_final_code"),
            F.max_by("code", "n").alias("_last_code"),
        )
        .select(
            "request_id",
            F.coalesce("_final_n", "_logged").alias("attempts_used"),
            F.coalesce("_final_code", "_last_code").alias("last_code"),
            F.coalesce(
                "_verdict", F.when(F.col("_logged") == max_attempts, "exhausted"), F.lit("pending")
            ).alias("outcome"),
        )
    )


def delivery_backoff(attempts: DataFrame) -> DataFrame:
    """Milliseconds waited before retries: 500 before the second try, 1000 before the third."""
    waits = (F.pow(F.lit(2), F.col("attempts_used") - 1) - 1) * C.BACKOFF_MS
    return delivery_outcome(attempts).select("request_id", waits.cast("bigint").alias("backoff_ms"))


def _judged_polls(polls: DataFrame) -> DataFrame:
    """Add `err`, the two earlier `err` marks and `verdict` to each poll."""
    given = polls.columns
    answered = F.col("answered") if "answered" in given else F.col("status").isNotNull()
    readable = F.coalesce("body_ok", F.lit(True)) if "body_ok" in given else F.lit(True)
    rows = polls.select(
        "file_id", "seq", "status", (~F.coalesce(answered, F.lit(False))).alias("err"), readable.alias("readable")
    )
    seen = run_lag(rows, ["file_id"], "seq", "err", C.MAX_ATTEMPTS - 1)
    third = F.col("err") & F.col("err_lag1") & F.col("err_lag2")
    verdict = (
        F.when(~F.col("err") & ~F.col("readable"), "error")
        .when(~F.col("err") & F.col("status").isin("completed", "failed"), F.col("status"))
        .when(third, "error")
    )
    return seen.withColumn("verdict", verdict)


def poll_outcome(polls: DataFrame) -> DataFrame:
    """Fold each file's polls up to the first that decides: completed, failed, an answer whose
    body cannot be read, or the third error in a row. A poll that answers ends a row of
    errors; one that answers without a status, or with any other, goes on.

    `seq` is an integer, unique per file. `answered` tells whether the poll got a 2xx answer
    and `body_ok` whether that could be read, as `remote_json.parse_status` gives
    them. Without `answered`, a null status means that the poll itself failed.
    """
    decided = F.col("verdict").isNotNull()
    return (
        _judged_polls(polls)
        .groupBy("file_id")
        .agg(
            F.min_by("verdict", F.when(decided, F.col("seq"))).alias("verdict"),
            F.min(F.when(decided, F.col("seq"))).alias("decided_at"),
        )
        .select("file_id", F.coalesce("verdict", F.lit("pending")).alias("outcome"), "decided_at")
    )


def poll_wait(polls: DataFrame) -> DataFrame:
    """Milliseconds waited between a file's polls, up to the one that decides: 2000 after an
    answer, 500 after a first error and 1000 after a second in a row. Takes what
    `poll_outcome` takes."""
    wait = (
        F.when(~F.col("err"), C.POLL_MS)
        .when(F.coalesce("err_lag1", F.lit(False)), 2 * C.BACKOFF_MS)
        .otherwise(C.BACKOFF_MS)
    )
    judged = _judged_polls(polls).withColumn("wait", wait)
    ends = judged.groupBy("file_id").agg(F.min(F.when(F.col("verdict").isNotNull(), F.col("seq"))).alias("_end"))
    # One row per file on the right; AQE splits a file that owns most polls.
    rows = judged.join(ends, "file_id").filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    return rows.groupBy("file_id").agg(
        F.count("*").alias("n_polls"),
        F.coalesce(F.sum(F.when(F.col("verdict").isNull(), F.col("wait"))), F.lit(0)).cast("bigint").alias("wait_ms"),
    )


def committable_uploads(uploads: DataFrame, polls: DataFrame, attaches: DataFrame) -> DataFrame:
    """Files whose upload, processing and attachment all succeeded; only these may be
    recorded as delivered. Inputs are outcome tables, one row per file."""
    up = uploads.filter("outcome = 'success'").select("file_id")
    done = polls.filter("outcome = 'completed'").select("file_id")
    attached = attaches.filter("outcome = 'success'").select("file_id")
    return up.join(done, "file_id", "left_semi").join(attached, "file_id", "left_semi")
