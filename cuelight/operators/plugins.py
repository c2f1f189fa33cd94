"""User callables over tables: analyzers and text models."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.semi import FENCE
from ..plans.session import scratch_path, written

# Retry defaults.
ATTEMPTS = 6
BASE_DELAY_SECONDS = 2.0


class PermanentError(Exception):
    """Raised by a callable when trying again cannot help."""


def call_with_retry(call: Callable, argument, attempts: int, base_delay: float) -> tuple[str | None, str | None]:
    """(reply, None) or (None, error) after exponential backoff."""
    error = "not called"
    for attempt in range(attempts):
        try:
            return call(argument), None
        except PermanentError as e:
            return None, f"{type(e).__name__}: {e}"
        except Exception as e:  # noqa: BLE001 - any provider error counts as transient
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < attempts:
                time.sleep(base_delay * 2**attempt)
    return None, error


def _has_json(reply: str) -> bool:
    """Whether the reply, or what its outermost braces hold, is JSON."""
    bare = re.sub(FENCE, "", reply.strip()).strip()
    for text in (bare, bare[bare.find("{"): bare.rfind("}") + 1]):
        try:
            json.loads(text)
            return True
        except ValueError:
            continue
    return False


class Pace:
    """At most ``rate`` calls a second, for the threads of one task."""

    def __init__(self, rate: float | None):
        self.rate, self.next, self.lock = rate, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.rate:
            return
        with self.lock:
            turn = max(self.next, time.monotonic())
            self.next = turn + 1.0 / self.rate
        time.sleep(max(0.0, turn - time.monotonic()))


def call_model(
    tasks: DataFrame,
    call: Callable[[dict], str],
    *,
    attempts: int = ATTEMPTS,
    base_delay: float = BASE_DELAY_SECONDS,
    ask_again: bool = True,
    partitions: int | None = None,
    concurrency: int = 1,
    rate: float | None = None,
) -> DataFrame:
    """Call ``call`` with every task row (as a dict) and add ``payload, error``.

    Partitions run at once, and in each of them up to ``concurrency`` calls, whose results keep the order of their rows. ``rate``
    is the most calls a second of all partitions together, shared out among them equally. Transient failures are retried with
    backoff; a reply without any JSON is asked for once more; a task that still
    fails gets an error row and no payload.
    """
    schema = StructType([*tasks.schema.fields, StructField("payload", StringType()), StructField("error", StringType())])
    spread = tasks.repartition(partitions) if partitions else tasks
    share = rate / spread.rdd.getNumPartitions() if rate else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(share)

        def paced(task: dict) -> str:
            pace.wait()
            return call(task)

        def one(task: dict) -> tuple[str | None, str | None]:
            reply, error = call_with_retry(paced, task, attempts, base_delay)
            if ask_again and error is None and not _has_json(reply or ""):
                reply, error = call_with_retry(paced, task, attempts, base_delay)
            return reply, error

        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for pdf in batches:
                given = pdf.to_dict("records")
                replies = list(pool.map(one, given)) if concurrency > 1 else [one(t) for t in given]
                yield pdf.assign(payload=[r for r, _ in replies], error=[e for _, e in replies])

    return spread.mapInPandas(run, schema)


def resumable_calls(tasks: DataFrame, call: Callable[[dict], str], path: str, namespace: str, per_batch: int = 1000, **options) -> DataFrame:
    """``key, payload, error`` for ``tasks`` (with a ``key``, each distinct key once), by calls that are never made again once
    they are recorded.

    Results are kept below ``path``, in the folder of ``namespace``. Tasks without one are dealt into batches of about ``per_batch``; each
    batch is called and recorded before the next begins, so a run that ends half-way loses the calls of one batch. Failed
    calls are not recorded: the next run takes them up. ``options`` are those of ``call_model``.
    """
    spark, place = tasks.sparkSession, f"{path}/{namespace}"
    schema = "key string, payload string"

    def known() -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, batch string").parquet(place).select("key", "payload")
        except AnalysisException:  # nothing is recorded yet
            return spark.createDataFrame([], schema)

    open_tasks = tasks.dropDuplicates(["key"]).join(known().select("key"), "key", "left_anti")
    run = uuid.uuid4().hex
    aside = scratch_path(spark, "calls")
    open_tasks = written(open_tasks, "open")
    batches = -(-open_tasks.count() // per_batch)
    if batches:
        number = F.pmod(F.xxhash64("key"), F.lit(batches)).alias("batch")
        open_tasks.select("*", number).repartition("batch").write.partitionBy("batch").parquet(aside)
    failed = spark.createDataFrame([], "key string, error string")
    for n in range(batches):
        try:
            batch = spark.read.schema(open_tasks.schema).parquet(f"{aside}/batch={n}")
        except AnalysisException:  # no key was dealt into it
            continue
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        results = written(call_model(batch.repartition(min(parts, per_batch)), call, **options).select("key", "payload", "error"), "results")
        results.filter("error IS NULL").select("key", "payload").coalesce(1).write.parquet(f"{place}/batch={run}-{n}")
        failed = failed.unionByName(results.filter("error IS NOT NULL").select("key", "error"))
    asked = tasks.select("key").distinct()
    return asked.join(known(), "key", "left").join(failed, "key", "left").select("key", "payload", "error")
