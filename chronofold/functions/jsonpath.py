"""Column expressions over VARIANT payloads: paths, identities, keys and text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted_key(key: str) -> str:
    """Variant path of one literal top-level key; dots are part of the key."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise ValueError(f"a key with both kinds of quotes can't be addressed: {key!r}")


def strict_json(value: Column) -> Column:
    """A text as VARIANT if it is one JSON value and nothing else, else NULL.

    The parser ignores what follows a value. So the text is parsed as the first entry of an array whose second is the text's
    own hash: anything beyond the value would change the array.
    """
    # the lambda keeps the parse from being repeated
    return F.element_at(F.transform(F.array(_with_end(value)), lambda x: F.when(_ended(x, value), F.get(x, F.lit(0)))), 1)


def _with_end(value: Column) -> Column:
    """A text and its hash as an array of VARIANT. Its entries are read as array entries: a variant path that leads nowhere throws, row by row."""
    return F.try_parse_json(F.concat(F.lit("["), value, F.lit(","), F.xxhash64(value).cast("string"), F.lit("]"))).cast("array<variant>")


def _ended(whole: Column, value: Column) -> Column:
    return (F.size(whole) == 2) & (F.get(whole, F.lit(1)).try_cast("bigint") == F.xxhash64(value))


def with_strict_json(df: DataFrame, value: Column, name: str, objects: bool = False) -> DataFrame:
    """``strict_json`` of a text as a new column, parsed once a row; ``objects``: NULL for anything but an object.

    Explodes of one element keep the optimizer from copying the parse, and lambdas out of the plan: it stays compiled code.
    """
    whole = F.col("whole_")
    raw = df.select("*", F.explode(F.array(_with_end(value))).alias("whole_"))
    fine = _ended(whole, value)
    if objects:  # what parses and starts with a brace is one
        fine = F.ltrim(value, F.lit(" \t\r\n")).startswith("{") & fine
    return raw.select("*", F.explode(F.array(F.when(fine, F.get(whole, F.lit(0))))).alias(name)).drop("whole_")


def parsed_payload(payload: Column) -> Column:
    """The payload as VARIANT if it is a JSON object, else NULL."""
    object_ = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.element_at(F.transform(F.array(strict_json(payload)), object_), 1)


def resolve(path: str, payload: Column, metadata: Column) -> Column:
    """``payload.<key>`` or ``metadata.<key>`` as VARIANT. Missing is NULL, JSON null is variant null."""
    root, dot, key = path.partition(".")
    if dot and root == "payload":
        return F.variant_get(payload, quoted_key(key), "variant")
    if dot and root == "metadata":
        return F.element_at(metadata, F.lit(key)).cast("variant")
    raise ValueError(f"a path starts with payload. or metadata.: {path!r}")


def is_scalar(v: Column) -> Column:
    """String, number or boolean; false for missing, null, object and array."""
    other = F.substring(F.schema_of_variant(v), 1, 5).isin("OBJEC", "ARRAY", "VOID")
    return v.isNotNull() & ~F.coalesce(other, F.lit(True))


def text(v: Column) -> Column:
    """Canonical text: strings bare, null empty, all else as JSON."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "VOID", F.lit("")).when(kind == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))


def json_key(parts: list[Column]) -> Column:
    """JSON array text of variants, a single part included."""
    return F.to_json(F.array(*parts))


def hex_key(key: Column) -> Column:
    return F.lower(F.hex(F.encode(key, "UTF-8")))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def file_safe(name: str) -> str:
    """The same for a name that the driver holds."""
    return re.sub("[^A-Za-z0-9_-]", "_", name)


def template(node, find: Callable[[str], Column], leaves: list[Column]) -> Column:
    """A template as VARIANT: string leaves are paths that ``find`` resolves, others literals. Path columns are appended to ``leaves``."""
    if isinstance(node, dict):
        if not node:
            return F.parse_json(F.lit("{}"))
        parts = [x for k, v in node.items() for x in (F.lit(str(k)), template(v, find, leaves))]
        return F.call_function("to_variant_object", F.call_function("named_struct", *parts))
    if isinstance(node, list):
        if not node:
            return F.parse_json(F.lit("[]"))
        return F.array(*[template(v, find, leaves) for v in node]).cast("variant")
    if isinstance(node, str):
        leaves.append(find(node))
        return leaves[-1]
    return F.parse_json(F.lit(json.dumps(node)))


def sequence_to_long(seq: Column) -> Column:
    """Unsigned 64-bit decimal to a signed long of the same order."""
    return (seq.cast("decimal(21,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def long_to_sequence(n: Column) -> Column:
    return (n.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)")
