"""JSON that models write: strict parsing with fallbacks, and defaults for missing keys."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = (re.compile(r"\{.*\}", re.S), re.compile(r"\[.*\]", re.S))


def parse(text: str | None) -> str | None:
    """The text as JSON, else its widest object, else its widest array; canonical text, or None."""
    if text is None:
        return None
    for found in (text, *(m[0] for p in _SPANS if (m := p.search(text)))):
        try:
            return json.dumps(json.loads(found), ensure_ascii=False)
        except (ValueError, RecursionError):
            continue
    return None


def _parse_all(text: pd.Series) -> pd.Series:
    return text.map(parse, na_action="ignore")


def strict_json(text: Column) -> Column:
    """``parse`` over Arrow batches: Spark's own parsers accept trailing text and reject NaN, which models' clients do not."""
    return F.pandas_udf(_parse_all, "string")(text)


def or_default(document: Column, key: str, default: str | None) -> Column:
    """A string field of a JSON object; the default only where the key is absent, null where it is JSON null."""
    held = F.from_json(document, "map<string,string>")
    return F.when(F.map_contains_key(held, key), F.element_at(held, key)).otherwise(F.lit(default))


def _constants_as_text(text: str | None) -> str | None:
    """Canonical text as ``parse`` gives it, with NaN and infinities as strings, which JSON proper has no numbers for."""
    found = parse(text)
    if found is None or not any(x in found for x in ("NaN", "Infinity")):
        return found
    return json.dumps(json.loads(found, parse_constant=str), ensure_ascii=False)


def _constants_as_text_all(text: pd.Series) -> pd.Series:
    return text.map(_constants_as_text, na_action="ignore")


def payload(text: Column) -> Column:
    """A model's answer as VARIANT: parsed once, strictly, with ``parse``'s fallbacks; null where it isn't JSON or nests deeper than VARIANT can."""
    return F.try_parse_json(F.pandas_udf(_constants_as_text_all, "string")(text))


def _path(key: str) -> str:
    return "$['" + key + "']"


def field(document: Column, key: str, default: str | None = None) -> Column:
    """A string field of a VARIANT object; the default only where the key is absent, null where it is JSON null. The text isn't parsed again."""
    held = F.try_variant_get(document, _path(key), "variant")
    return F.when(held.isNull(), F.lit(default)).otherwise(F.try_variant_get(document, _path(key), "string"))


def items(document: Column, key: str) -> Column:
    """The elements of an array field of a VARIANT object; null where the key is absent or no array."""
    return F.try_variant_get(document, _path(key), "array<variant>")
