"""Alerts of a stream, sent once: a ledger of what was begun and what was sent.

Before a batch sends, it writes its alerts as begun, under its own number; after that, how each went. A batch that runs again, and an alert that comes
again in a later one, are found and send nothing. An alert that was begun but has no outcome, because the job ended between, may or may not have gone
out: ``unconfirmed`` lists these, and ``retry`` sends those that failed for sure.

Alerts are items times people, so the ledger doesn't hold a row for each: an item has a row for each set of people that it was sent to, and a set, which the
items of a project share, is stored once. Its three tables grow with items, people and failures: ``items`` (item, more, set, again, batch), ``sets``
(set, people) and ``results`` (item, set, errors, batch), where ``errors`` goes along the people of the set and is null if all were sent. Items and people
are JSON, so tables of other columns fit in; a set's name is its hash. ``items`` and ``results`` are partitioned by ``batch``, and a batch overwrites its own
partition only, so writing twice is writing once; sets are only ever added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StructType

from tallystone.operators.monitoring import PEOPLE, SHARES, addressed, alerted
from tallystone.sources.shared import exists, remove

#: What makes two alerts the same; the last column says to whom, those before about what.
KEY = ("project_id", "item_type", "reference_id", "email")
#: Errors that a task holds before it gives them on.
ERRORS = 100_000
_KINDS = {
    "items": "item string, more string, set string, again boolean, batch bigint",
    "sets": "set string, people array<struct<k:string,row:string>>",
    "results": "item string, set string, errors array<string>, batch bigint",
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    if exists(spark, f"{path}/begun"):
        raise ValueError(f"{path} is a ledger of the older layout, a row for each alert")
    return spark.read.schema(_KINDS[name]).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else spark.createDataFrame([], _KINDS[name])


def _write(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")


def _kept(df: DataFrame, at: str) -> DataFrame:
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")


def _merged(a: Column, b: Column) -> Column:
    """Two JSON objects as one."""
    both = F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit(","), F.substring(b, F.lit(2), F.length(b) - 1))
    return F.when(b == "{}", a).when(a == "{}", b).otherwise(both)


def _sets(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "sets").dropDuplicates(["set"])


def _in_sets(rows: DataFrame, by: str) -> DataFrame:
    """(by, set, people) of ``rows(by, p)``: the people of each value in order of their keys, ``PEOPLE`` at most, each key once."""
    order = Window.partitionBy(by).orderBy("k")
    rows = rows.withColumn("k", F.col("p.k")).withColumn("_last", F.lag("k").over(order)).withColumn("_b", F.expr(f"(dense_rank() over (partition by {by} order by k) - 1) div {PEOPLE}"))
    held = rows.where("_last is null or _last <> k").groupBy(by, "_b").agg(F.sort_array(F.collect_list("p")).alias("people"))
    return held.select(by, F.sha2(F.to_json("people"), 256).alias("set"), "people")


def _dealt(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a ``share``: the items of a set are dealt over ``SHARES`` shares, and the set is there for each of them."""
    rows = rows.withColumn("share", F.pmod(F.xxhash64("item"), F.lit(SHARES)).cast("int"))
    return rows, sets.join(rows.select("set", "share").distinct(), "set")


def _entries(spark: SparkSession, path: str, about: Column, person: Callable[[Column], Column]) -> DataFrame:
    """(about, p, batch, sent, error) of each alert; ``person`` makes p of (k, row), once for each set. A later outcome counts, a success before all."""
    items = _read(spark, path, "items")
    done = _read(spark, path, "results").withColumn("done", F.lit(True))
    held = _sets(spark, path).select("set", F.transform("people", lambda x: F.struct(x["k"].alias("k"), person(x).alias("p"))).alias("people"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def each(mine: DataFrame) -> DataFrame:
        rows, told = _dealt(mine.join(done, ["item", "set", "batch"], "left").withColumn("about", about), held)
        told = told.repartition(n, "set", "share").hint("shuffle_hash")
        found = rows.repartition(n, "set", "share").join(told, ["set", "share"]).select("item", "about", "batch", "done", "errors", F.posexplode("people").alias("pos", "x"))
        error = F.get("errors", F.col("pos"))
        return found.select("item", F.col("x.k").alias("k"), "about", F.col("x.p").alias("p"), "batch", F.when(F.col("done"), error.isNull()).alias("sent"), error.alias("error"))

    columns = ["about", "p", "batch", "sent", "error"]
    twice = items.where("again").select("item").distinct()
    if twice.isEmpty():
        return each(items).select(*columns)
    # only what was retried can have more than one entry
    last = F.max_by(F.struct("sent", "error"), F.struct("sent", "batch")).alias("o")
    retried = each(items.join(twice, "item", "left_semi")).groupBy("item", "k").agg(F.min_by(F.struct("about", "p", "batch"), "batch").alias("e"), last)
    return each(items.join(twice, "item", "left_anti")).select(*columns).unionByName(retried.select("e.about", "e.p", "e.batch", "o.sent", "o.error"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(key, alert, batch, sent, error): each alert that was begun; without an outcome ``sent`` is null."""
    item, more = F.col("item"), F.col("more")
    found = _entries(spark, path, F.struct(item.alias("item"), _merged(item, more).alias("row")), lambda x: x)
    return found.select(F.sha2(_merged(F.col("about.item"), F.col("p.k")), 256).alias("key"), _merged(F.col("about.row"), F.col("p.row")).alias("alert"), "batch", "sent", "error")


def entries(spark: SparkSession, path: str, about: StructType, person: StructType) -> DataFrame:
    """The alerts as columns, those of the item and those of the person, with batch, sent and error."""
    found = _entries(spark, path, F.from_json(_merged(F.col("item"), F.col("more")), about), lambda x: F.from_json(x["row"], person))
    return found.select("about.*", "p.*", "batch", "sent", "error")


def unconfirmed(spark: SparkSession, path: str) -> DataFrame:
    return ledger(spark, path).where("sent is null")


def deliver(rows: DataFrame, connect: Callable[[], Callable[[dict], None]]) -> DataFrame:
    """Sends to all people of a set what a row is about and says how it went: (item, set, errors). A set's row with ``people`` goes before its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send, people, done, held = None, [], [], 0
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), (pa.string(), pa.string(), pa.list_(pa.string())))], ["item", "set", "errors"])
        for batch in batches:
            for item, name, about, told in zip(*(batch.column(c).to_pylist() for c in ("item", "set", "about", "people")), strict=True):
                if told is not None:
                    people = told
                    continue
                errors: list[str | None] | None = None
                for i, person in enumerate(people):
                    try:
                        send = send or connect()
                        send({**about, **person})
                    except Exception as e:  # the row says what went wrong
                        errors = errors or [None] * len(people)
                        errors[i] = str(e)
                done.append((item, name, errors))
                held += len(errors or "")
                if held > ERRORS or len(done) > ERRORS:
                    yield as_batch()
                    done, held = [], 0
        if done:
            yield as_batch()

    return rows.mapInArrow(run, "item string, set string, errors array<string>")


def _fresh(spark: SparkSession, path: str, about: DataFrame, sets: DataFrame, retry: bool, work: str) -> tuple[DataFrame, DataFrame]:
    """What of ``about(item, more, set)`` the ledger doesn't have, and its sets. An item that is known with other people goes to those who are new."""
    begun = _read(spark, path, "items")
    if retry:  # whose sending failed isn't known
        failed = F.filter(F.transform("errors", lambda e, i: F.when(e.isNotNull(), i)), lambda i: i.isNotNull())
        known = begun.join(_read(spark, path, "results"), ["item", "set", "batch"], "left").withColumn("bad", F.coalesce(failed, F.array().cast("array<int>")))
    else:
        known = begun.withColumn("bad", F.array().cast("array<int>"))
    rest = about.join(known.where("size(bad) = 0").select("item", "set"), ["item", "set"], "left_anti")
    by_item = known.groupBy("item").agg(F.sort_array(F.collect_set(F.struct("set", "bad"))).alias("known"))
    case = F.when(F.col("known").isNotNull(), F.sha2(F.to_json(F.struct("set", "known")), 256))
    met = _kept(rest.join(by_item, "item", "left").withColumn("case", case), f"{work}/met")
    # people are compared once for each case, a set and the sets known before, and not for each item
    cases = met.where("case is not null").dropDuplicates(["case"])
    new = cases.join(sets, "set").select("case", F.explode("people").alias("p")).withColumn("k", F.col("p.k"))
    old = cases.select("case", F.inline("known")).join(_sets(spark, path), "set").select("case", "bad", F.posexplode("people").alias("pos", "p"))
    old = old.where(~F.array_contains("bad", F.col("pos"))).select("case", F.col("p.k").alias("k"))
    left = _kept(_in_sets(new.join(old, ["case", "k"], "left_anti").select("case", "p"), "case"), f"{work}/left")
    whole = met.where("case is null").select("item", "more", "set", F.lit(False).alias("again"))
    part = met.where("case is not null").drop("set").join(left.select("case", "set"), "case").select("item", "more", "set", F.lit(retry).alias("again"))
    return whole.unionByName(part), sets.unionByName(left.select("set", "people"))


def _send(about: DataFrame, sets: DataFrame, number: int, path: str, connect: Callable[[], Callable[[dict], None]], kinds: tuple[StructType, StructType], retry: bool, work: str) -> None:
    """``about(item, more, set)``, each once, to the people of ``sets(set, people)``, both written before."""
    spark = about.sparkSession
    # a number of its own for each try, as a batch that runs again must leave its first entries alone
    tries = _read(spark, path, "items").where(F.expr("batch div 1000") == number).select("batch").distinct().count()
    own = F.lit(number * 1000 + tries).cast("long").alias("batch")
    fresh, sets = _fresh(spark, path, about, sets, retry, work) if exists(spark, f"{path}/items") else (about.withColumn("again", F.lit(False)), sets)
    fresh = _kept(fresh, f"{work}/fresh")
    used = sets.join(fresh.select("set").distinct(), "set", "left_semi").join(_read(spark, path, "sets").select("set"), "set", "left_anti")
    used.dropDuplicates(["set"]).write.mode("append").parquet(f"{path}/sets")
    _write(fresh.select("item", "more", "set", "again", own), path, "items")
    # what is sent is what was written, whatever is computed twice
    what, whom = kinds
    rows, told = _dealt(_read(spark, path, "items").where(F.col("batch") == number * 1000 + tries), _sets(spark, path))
    rows = rows.select("set", "share", "item", F.from_json(_merged(F.col("item"), F.col("more")), what).alias("about"), F.lit(None).cast(ArrayType(whom)).alias("people"))
    told = told.select("set", "share", F.lit(None).cast("string").alias("item"), F.lit(None).cast(what).alias("about"), F.transform("people", lambda x: F.from_json(x["row"], whom)).alias("people"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.unionByName(told).repartition(n, "set", "share").sortWithinPartitions("set", "share", F.col("people").isNull())
    _write(deliver(rows, connect).select("item", "set", "errors", own), path, "results")
    remove(spark, work)


def send_batch(outbox: DataFrame, number: int, path: str, connect: Callable[[], Callable[[dict], None]], key: tuple[str, ...] = KEY, retry: bool = False) -> None:
    """Sends the alerts of one batch that the ledger doesn't have; with ``retry`` also those whose sending failed."""
    what, whom = (key[:-1], key[-1:]) if len(key) > 1 else (key, ())
    rest, work = [c for c in outbox.columns if c not in what], f"{path}/_work/{number}"
    rows = outbox.select(_json(what).alias("item"), F.struct(_json(whom).alias("k"), _json(rest).alias("row")).alias("p"))
    held = _kept(_in_sets(rows, "item"), f"{work}/outbox")
    kinds = StructType([outbox.schema[c] for c in what]), StructType([outbox.schema[c] for c in rest])
    _send(held.select("item", F.lit("{}").alias("more"), "set"), held.select("set", "people").dropDuplicates(["set"]), number, path, connect, kinds, retry, work)


def send_alerts(items: DataFrame, stakeholders: DataFrame, number: int, path: str, connect: Callable[[], Callable[[dict], None]], item_type: str | None = "NEW_REQUEST", retry: bool = False) -> tuple[StructType, StructType]:
    """Sends the rows of ``monitoring.alerts`` as a batch, without making a row of each; gives the columns of items and of people, as ``entries`` takes them."""
    flagged, told = addressed(items, stakeholders, item_type)
    what, work = list(KEY[:-1]), f"{path}/_work/{number}"
    whom = [c for c in told.columns if c != "project_id"]
    flagged = alerted(flagged)
    more = [c for c in flagged.columns if c not in what]
    people = told.select("project_id", F.struct(_json(KEY[-1:]).alias("k"), _json(whom).alias("row")).alias("p"))
    held = _kept(_in_sets(people, "project_id"), f"{work}/people")
    rows = flagged.join(held.select("project_id", "set"), "project_id").select(_json(what).alias("item"), _json(more).alias("more"), "set").dropDuplicates(["item", "set"])
    kinds = StructType([flagged.schema[c] for c in what + more]), StructType([told.schema[c] for c in whom])
    _send(rows, held.select("set", "people").dropDuplicates(["set"]), number, path, connect, kinds, retry, work)
    return kinds


def start_delivery(outbox: DataFrame, path: str, checkpoint: str, connect: Callable[[], Callable[[dict], None]], key: tuple[str, ...] = KEY, retry: bool = False) -> StreamingQuery:
    """Follows a stream of outbox rows and sends each alert once."""
    writer = outbox.writeStream.foreachBatch(lambda df, number: send_batch(df, number, path, connect, key, retry))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
