"""Recover exactly one JSON object from model output."""

from __future__ import annotations

import contextlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: A quoted string, closed or running to the end, or a brace.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.DOTALL)


def _objects(text: str) -> tuple[list[dict], bool]:
    """Valid objects among the outermost balanced braces, and whether braces stay open."""
    found, opened = [], []
    for token in _TOKENS.finditer(text):
        if token.group() == "{":
            opened.append(token.start())
        elif token.group() == "}" and opened:
            start = opened.pop()
            if not opened:
                with contextlib.suppress(ValueError):
                    found.append(json.loads(text[start : token.end()]))
    return found, bool(opened)


def _recover(raw: str | None) -> tuple[str | None, bool, str | None]:
    text = (raw or "").strip()
    if not text:
        return None, False, "empty model output"
    try:
        whole = json.loads(text)
    except ValueError:
        objects, unfinished = _objects(text)
        if len(objects) == 1:
            return json.dumps(objects[0]), True, None
        if objects:
            return None, False, f"output contains {len(objects)} competing top-level JSON objects; ambiguous"
        return None, False, (
            "truncated or unterminated JSON object" if unfinished else "no valid top-level JSON object found in output"
        )
    if isinstance(whole, dict):
        return json.dumps(whole), False, None
    return None, False, f"top-level JSON is a {type(whole).__name__}, not an object"


def recover_json(raw: Column) -> Column:
    """Struct of the object as JSON text, whether prose was cut away, and the error.

    Flat clean objects are settled by built-in functions; only the rest, where braces must be matched around
    strings, goes to Python in Arrow batches.
    """

    @F.pandas_udf("json string, recovered boolean, error string")
    def recover(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_recover(v) for v in values], columns=["json", "recovered", "error"])

    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    flat = F.regexp_like(text, F.lit(r"^\{[^{}]*\}$"))  # one pair of braces around everything
    clean = flat & F.try_parse_json(text).isNotNull()
    settled = F.coalesce(clean, F.lit(False))
    python = recover(F.when(~settled, raw))
    whole = F.struct(text.alias("json"), F.lit(False).alias("recovered"), F.lit(None).cast("string").alias("error"))
    return F.when(settled, whole).otherwise(python)
