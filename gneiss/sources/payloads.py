"""Text out of the JSON that document services answer with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _string(v: str, path: str) -> Column:
    """The string at a path, null where there is none, it is no string, or it is blank."""
    at = f"try_variant_get({v}, '{path}', 'variant')"
    return F.expr(f"case when schema_of_variant({at}) = 'STRING' then nullif(try_variant_get({v}, '{path}', 'string'), '') end")


def _chunks(path: str) -> Column:
    """Contents of a list of chunks, two line breaks between; null without any."""
    good = "schema_of_variant(try_variant_get(c, '$.content', 'variant')) = 'STRING' and trim(try_variant_get(c, '$.content', 'string')) <> ''"
    kind = f"schema_of_variant(try_variant_get(v, '{path}', 'variant')) like 'ARRAY%'"
    texts = f"transform(filter(try_variant_get(v, '{path}', 'array<variant>'), c -> {good}), c -> try_variant_get(c, '$.content', 'string'))"
    return F.expr(f"case when {kind} then nullif(array_join({texts}, '\\n\\n'), '') end")


def _whole(payload: str) -> str:
    """SQL: the payload as a variant; null unless all of it is one JSON value.

    The parser passes over what follows a value.  So the payload is read within lists that end in its own digest, which it cannot
    hold itself: only where the digest is met as the second of two, beside a list of one, has all been read as one value.
    """
    end = f"sha2({payload}, 256)"
    whole = f"""transform(array(try_parse_json(concat('[[', {payload}, '],"', {end}, '"]'))), w -> schema_of_variant(try_variant_get(w, '$[0]', 'variant')) like 'ARRAY%'
        and size(try_variant_get(w, '$', 'array<variant>')) = 2 and size(try_variant_get(w, '$[0]', 'array<variant>')) = 1 and try_variant_get(w, '$[1]', 'string') = {end})[0]"""
    return f"case when {whole} then try_parse_json({payload}) end"


def payload_text(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with ``text, error`` instead of the JSON: the Markdown that it holds.

    In order: ``markdown`` and ``content`` at the top and under ``result``, then the chunks under ``result``, then those at the top.  Blank strings and
    values of other types are passed over.  What is no JSON, no object, or holds no text has an error and no text.
    """
    v = payloads.withColumn("v", F.expr(_whole(column)))
    direct = [_string("v", p) for p in ("$.markdown", "$.content", "$.result.markdown", "$.result.content")]
    text = F.coalesce(*(F.when(F.trim(d) != "", d) for d in direct), _chunks("$.result.chunks"), _chunks("$.chunks"))
    is_object = F.expr("coalesce(schema_of_variant(v) like 'OBJECT%', false)")
    out = v.withColumn("text", F.when(is_object, text))
    error = F.when(F.col("v").isNull(), "not JSON").when(~is_object, "not an object").when(F.col("text").isNull(), "no text")
    return out.withColumn("error", error).drop(column, "v")
