"""Answers of a model, stored by prompt, so that a job that was cut short asks nothing twice.

A table of answers (key, answer, error, asked_at), partitioned by batch: ``key`` is the SHA-256 of a prompt. ``ask`` looks for prompts without an answer,
deals them into batches by their key and appends one batch after the other; each is settled before the next is asked. A prompt that a table of
rows has many times is asked once. Failed prompts are rows with an error; they are asked again by the next ``ask`` only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from datetime import datetime, timezone
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.functions.json_text import parse
from tallystone.sources.shared import exists, folder, remove

#: From a prompt to its answer; whatever it raises is the prompt's error.
Client = Callable[[str], str]
BATCH, MOST_BATCHES, TIMEOUT, PARALLEL = 10_000, 1000, 300.0, 4
_ROW = "key string, answer string, error string, asked_at timestamp"


def http_client(url: str, model: str, timeout: float = TIMEOUT) -> Callable[[], Client]:
    """A client of a completion service: posts ``model``, ``prompt`` and ``stream`` as JSON and reads ``response``, empty without one."""

    def connect() -> Client:
        def ask(prompt: str) -> str:
            body = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode()
            request = Request(url, body, {"Content-Type": "application/json"})
            with urlopen(request, timeout=timeout) as reply:
                return json.load(reply).get("response", "")

        return ask

    return connect


def key_of(prompt: Column) -> Column:
    return F.sha2(prompt.cast("string"), 256)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer, error): what is known of each prompt; an answer goes before errors, a later error before an earlier one."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, answer string, error string")
    rows = spark.read.schema(_ROW).parquet(path)
    order = Window.partitionBy("key").orderBy(F.col("answer").isNull(), F.desc("asked_at"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("key", "answer", "error")


def _asker(connect: Callable[[], Client], timeout: float, as_json: bool):
    def one(client: Client, prompt: str) -> str:
        answer = client(prompt)
        if as_json:
            found = parse(answer)
            if found is None:  # asked once more, with what was wrong
                found = parse(client(f"{prompt}\nReturn valid JSON only."))
            if found is None:
                raise ValueError("no JSON")
            return found
        return answer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client: Client | None = None
        pool = ThreadPoolExecutor(PARALLEL)
        try:
            for pdf in batches:
                out = []
                try:
                    client = client or connect()
                    jobs = [(key, pool.submit(one, client, prompt)) for key, prompt in zip(pdf["key"], pdf["prompt"], strict=True)]
                except Exception as e:  # no connection: every prompt of the batch says so
                    jobs, out = [], [(key, None, str(e) or type(e).__name__) for key in pdf["key"]]
                for key, job in jobs:
                    try:
                        out.append((key, job.result(timeout), None))
                    except TooLate:
                        job.cancel()
                        out.append((key, None, f"no answer in {timeout:g} s"))
                    except Exception as e:
                        out.append((key, None, str(e) or type(e).__name__))
                frame = pd.DataFrame(out, columns=["key", "answer", "error"])
                yield frame.assign(asked_at=pd.Timestamp(datetime.now(timezone.utc).replace(tzinfo=None)))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run


def ask(spark: SparkSession, path: str, rows: DataFrame, prompt: str, connect: Callable[[], Client], as_json: bool = False, batch: int = BATCH, timeout: float = TIMEOUT) -> int:
    """Asks for all prompts of ``rows`` that have no answer in ``path``; returns how many that were.

    ``connect`` makes a client, once for each task. A prompt whose answer isn't there ``timeout`` seconds after it is waited for, or that fails, gets an
    error and ends nothing. With ``as_json`` an answer must be JSON, is asked for once more if it isn't, and is stored as canonical text. A null
    prompt is never asked. Only keys are read of what is stored.
    """
    wanted = rows.where(F.col(prompt).isNotNull()).select(key_of(F.col(prompt)).alias("key"), F.col(prompt).cast("string").alias("prompt")).dropDuplicates(["key"])
    open_, at = wanted.join(stored(spark, path).where("answer is not null").select("key"), "key", "left_anti"), folder(spark, "prompts")
    # settled once, in shares by the key, so that each batch reads its own; keys are hashes, so shares are equal
    open_.write.parquet(f"{at}/all")
    held = spark.read.parquet(f"{at}/all")
    n = held.count()
    parts = min(MOST_BATCHES, -(-n // batch))
    if parts:
        share = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(parts)).alias("share")
        held.select("key", "prompt", share).repartition("share").write.partitionBy("share").parquet(f"{at}/shares")
        shares = spark.read.parquet(f"{at}/shares")
        for i in range(parts):
            mine = shares.where(F.col("share") == i).select("key", "prompt").repartition(max(1, spark.sparkContext.defaultParallelism), "key")
            mine.mapInPandas(_asker(connect, timeout, as_json), _ROW).write.mode("append").parquet(path)
    remove(spark, at)
    return n


def answered(spark: SparkSession, path: str, rows: DataFrame, prompt: str, out: str = "payload") -> DataFrame:
    """The rows, all columns, with their prompts' answers and ``<out>_error``; a prompt that was never asked has neither."""
    known = stored(spark, path).select(F.col("key").alias("_key"), F.col("answer").alias(out), F.col("error").alias(f"{out}_error"))
    return rows.withColumn("_key", key_of(F.col(prompt))).join(known, "_key", "left").drop("_key")
