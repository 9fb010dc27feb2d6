"""Extraction payloads to rows: parse, explode, fill defaults. A model is any function from prompts to texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallystone.functions.json_text import field as variant_field
from tallystone.functions.json_text import items as variant_items
from tallystone.functions.json_text import or_default, parse
from tallystone.functions.text import prompt_prefix

#: Prompts that a model gets at once, and their bytes; one that is longer goes alone.
PROMPTS, PROMPT_BYTES = 256, 16 << 20
# Defaults of missing keys.
SCOPE_ITEM = {"name": "Unknown", "description": "", "scope_type": "UNCERTAIN", "evidence_text": ""}
ACTIVITY = {"activity_name": "Unknown", "activity_status": "UNKNOWN", "evidence_text": ""}
REQUEST = {"request_name": "Unknown", "evidence_text": ""}
DELIVERABLE = {"name": "Unknown", "description": "", "deadline": None, "owner": None}
STAKEHOLDER = {"name": "Unknown", "role": "", "responsibility": ""}
# Fields of the payloads.
SCOPE_FIELDS = {
    "scope_items": ["name", "description", "scope_type", "source_page", "source_section", "evidence_text", "confidence"],
    "deliverables": ["name", "description", "deadline", "owner"],
    "stakeholders": ["name", "role", "responsibility"],
}
STATUS_FIELDS = {
    "activities": ["activity_name", "description", "activity_status", "progress_percentage", "requested_by", "owner", "mentioned_deadline", "source_page", "source_section", "evidence_text", "confidence"],
    "new_requests": ["request_name", "requested_by", "source_page", "evidence_text"],
}


def _few(batch: pa.RecordBatch, prompt: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices that a model gets at once."""
    sizes, start, held = pc.fill_null(pc.binary_length(batch.column(prompt)), 0).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == PROMPTS or held + size > PROMPT_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if sizes:
        yield batch.slice(start)


def generate_json(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], out: str = "payload", drop: Sequence[str] = ()) -> DataFrame:
    """Adds a model's answer as JSON text, and ``<out>_error``, without the columns of ``drop``. An answer that isn't JSON is asked for once more.

    The model gets ``PROMPTS`` prompts or ``PROMPT_BYTES`` of them at a time at most. Only these are Python texts at once, however wide and many the rows
    of a batch are.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = StructType([*kept, StructField(out, StringType()), StructField(f"{out}_error", StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _few(batch, prompt):
                prompts = part.column(prompt).to_pylist()
                found = [parse(x) for x in model(prompts)]
                again = [i for i, x in enumerate(found) if x is None]
                if again:
                    for i, x in zip(again, model([f"{prompts[i]}\nReturn valid JSON only." for i in again]), strict=True):
                        found[i] = parse(x)
                added = [pa.array(found, pa.string()), pa.array([None if x is not None else "no JSON" for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *added], [*names, out, f"{out}_error"])

    return df.mapInArrow(run, schema)


def _asked(task: str, lists: dict[str, list[str]], text: Column) -> Column:
    """A prompt: the task, the lists of objects wanted, and the text; a document without one shows none."""
    wanted = "; ".join(f"{name}: objects with {', '.join(keys)}" for name, keys in lists.items())
    return F.concat(F.lit(f"{task} Answer with one JSON object and nothing else. It holds {wanted}. Use null where the text says nothing."), F.coalesce(F.concat(F.lit("\n\nText:\n"), text), F.lit("")))


def _extracted(documents: DataFrame, task: str, lists: dict[str, list[str]], text: Column, model) -> DataFrame:
    rows = documents.withColumn("_prompt", _asked(task, lists, text)).drop("text")
    return generate_json(rows, "_prompt", model, drop=["_prompt"])


def extract_scope(documents: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``documents`` without ``text``, with ``payload`` and ``payload_error``: scope items, deliverables and stakeholders of a contract, from its whole text."""
    return _extracted(documents, "Find what this engagement letter or approval puts in and out of scope.", SCOPE_FIELDS, F.col("text"), model)


def extract_status(documents: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``documents`` without ``text``, with ``payload`` and ``payload_error``: activities and new requests of a report or minutes, from the first characters of its text."""
    return _extracted(documents, "Find the activities and the new requests in this status report or these minutes.", STATUS_FIELDS, prompt_prefix(F.col("text")), model)


def scope_rows(extracted: DataFrame, keep: list[str]) -> dict[str, DataFrame]:
    """The rows of each list of a scope payload, with defaults for keys that are missing."""
    defaults = {"scope_items": SCOPE_ITEM, "deliverables": DELIVERABLE, "stakeholders": STAKEHOLDER}
    return {name: explode_items(extracted, F.col("payload"), name, keep).select(*keep, "pos", *filled(F.col("item"), d)) for name, d in defaults.items()}


def status_rows(extracted: DataFrame, keep: list[str]) -> dict[str, DataFrame]:
    defaults = {"activities": ACTIVITY, "new_requests": REQUEST}
    return {name: explode_items(extracted, F.col("payload"), name, keep).select(*keep, "pos", *filled(F.col("item"), d)) for name, d in defaults.items()}


def explode_items(df: DataFrame, payload: Column, field: str, keep: list[str]) -> DataFrame:
    """One row for each object in an array field of a JSON payload: ``keep``, ``pos`` and the object's text, ``item``."""
    items = F.from_json(F.get_json_object(payload, f"$.{field}"), "array<string>")
    return df.select(*keep, F.posexplode(items).alias("pos", "item"))


def filled(item: Column, defaults: dict[str, str]) -> list[Column]:
    return [or_default(item, k, v).alias(k) for k, v in defaults.items()]


def first_named(item: Column, *keys: str) -> Column:
    """The first key that the object has, by presence and not by value; empty text without any."""
    held = F.from_json(item, "map<string,string>")
    out = F.lit("")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(held, key), F.element_at(held, key)).otherwise(out)
    return out


def variant_rows(df: DataFrame, document: str, lists: dict[str, dict[str, str | None]], keep: list[str]) -> DataFrame:
    """(keep, list, pos, fields) for each element of each named array field of a VARIANT column, in one pass over the rows.

    ``fields`` is a map of the list's keys, with the default of those that the element lacks. A document is parsed once, whatever the number of lists and
    keys; lists that are absent or no arrays give nothing.
    """

    def filled_in(name: str, defaults: dict[str, str | None]) -> Column:
        one = lambda x: F.create_map(*(c for k, v in defaults.items() for c in (F.lit(k), variant_field(x, k, v))))
        return F.transform(variant_items(F.col(document), name), lambda x, i: F.struct(F.lit(name).alias("list"), i.alias("pos"), one(x).alias("fields")))

    found = F.concat(*(F.coalesce(filled_in(n, d), F.array().cast("array<struct<list:string,pos:int,fields:map<string,string>>>")) for n, d in lists.items()))
    return df.select(*keep, F.inline(found))
