"""Tags and context: JSON text ↔ typed columns.

Tags are stored as a JSON array of ``{"key", "value"}`` objects. Duplicate keys
are legal and counted separately, so the typed form is an array of structs,
not a map. ``from_json`` would turn a lone object into a one-element array, so
parsing is guarded by ``json_array_length`` (null for objects, scalars,
malformed text and null input).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

TAG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
TAGS = T.ArrayType(TAG)
CONTEXT = T.MapType(T.StringType(), T.StringType())


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_json_array(col="tags") -> Column:
    """Text that can only be a JSON array: it begins with ``[`` and ends with ``]``.

    A cheap textual test instead of a full parse; malformed text that passes
    it still comes out of the parse as null (then treated as no tags)."""
    c = _c(col)
    return F.coalesce(c.rlike(r"^[ \t\r\n]*\[") & c.rlike(r"\][ \t\r\n]*\z"), F.lit(False))


def tag_elements(col="tags") -> Column:
    """One tag for each element of a JSON array, else null (drops out of an inner explode).

    As SQL unnests it: an element that isn't an object is a tag without key and
    value. Only arrays that have one are parsed a second time."""
    c = _c(col)
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    any_element = F.transform(items, lambda e: F.struct(F.try_variant_get(e, "$.key", "string").alias("key"),
                                                        F.try_variant_get(e, "$.value", "string").alias("value")))
    return F.coalesce(parse_tags_or_null(c), F.when(is_json_array(c), any_element.cast(TAGS)))


def parse_tags_or_null(col="tags") -> Column:
    """Typed tags for a JSON array of objects, else null."""
    c = _c(col)
    return F.when(is_json_array(c), F.from_json(c, TAGS))


def parse_tags(col="tags") -> Column:
    """Typed tags; null, blank, non-array and malformed input become []."""
    return F.coalesce(parse_tags_or_null(col), F.array().cast(TAGS))


def tags_to_json(col) -> Column:
    """Serialize typed tags; null or empty → null."""
    c = _c(col)
    return F.when(F.size(c) > 0, F.to_json(c))


def parse_context(col="context") -> Column:
    """Context object as map<string,string>; null, blank, malformed → {}.

    Nested values are kept as their JSON text."""
    c = _c(col)
    parsed = F.when(~c.rlike(r"^[\x00-\x20]*$"), F.from_json(c, CONTEXT, {"mode": "PERMISSIVE"}))
    return F.coalesce(parsed, F.create_map().cast(CONTEXT))


def typed_context(col: str = "context") -> Column:
    """Context object as a variant, with its values' types; null, blank, malformed and what isn't an object → {}."""
    value = F.expr(whole_json_sql(f"`{col}`"))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.coalesce(F.when(is_object, value), F.parse_json(F.lit("{}")))


def context_to_json(col) -> Column:
    c = _c(col)
    return F.when(F.size(c) > 0, F.to_json(c))


def tag_count(col="tags") -> Column:
    return F.size(parse_tags(col))


def context_key_count(col="context") -> Column:
    return F.size(F.map_keys(parse_context(col)))


def whole_json_sql(text: str) -> str:
    """SQL text of a JSON text as a variant if it is one value and nothing else, else null.

    The parser stops after the first value, so text behind it goes unseen.
    Inside an array that text would have to begin with ``]`` or ``,`` and
    inside an object with ``}`` or ``,`` to get past it: none does both, and a
    comma makes a second element."""
    return (f"CASE WHEN try_parse_json(concat('{{\"v\":', {text}, '}}')) IS NOT NULL AND "
            f"size(try_variant_get(try_parse_json(concat('[', {text}, ']')), '$', 'array<variant>')) = 1 THEN try_parse_json({text}) END")


def parse_or_raw(col: str) -> Column:
    """Re-serialize valid JSON text, otherwise pass the raw text through."""
    return F.coalesce(F.to_json(F.expr(whole_json_sql(f"`{col}`"))), F.col(col).cast("string"))


def has_tag(key: str, value: str, col="tags") -> Column:
    """Containment of one {key, value} pair in the same element."""
    return F.coalesce(
        F.exists(tag_elements(col), lambda t: (t["key"] == F.lit(key)) & (t["value"] == F.lit(value))),
        F.lit(False))
