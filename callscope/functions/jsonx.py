"""Strictly-typed JSON access, prompt fingerprinting and redaction as column expressions.

Bodies are parsed once with ``try_parse_json`` (invalid JSON -> NULL, never
an error) into a VARIANT column. Accessors check the JSON type first, so a
numeric ``"model": 42`` is *not* read as the string ``"42"`` and ``10.0``
is not an integer token count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a 64-bit parameters (offset basis split in 32-bit halves;
# prime = 2^40 + 435).
FNV_OFFSET_HI = 0xCBF29CE4
FNV_OFFSET_LO = 0x84222325
FNV_PRIME_LOW = 435
REDACTED = "[REDACTED]"


def parse(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_parse_json(c)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def jtype(v: Column, path: str = "$") -> Column:
    """JSON type name at ``path`` (STRING, BIGINT, BOOLEAN, OBJECT<...>, ARRAY<...>, ...)."""
    return F.schema_of_variant(_at(v, path))


def jstr(v: Column, path: str) -> Column:
    """String at ``path`` only when it is a JSON string, else NULL."""
    return F.when(jtype(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def jint(v: Column, path: str) -> Column:
    """Integer at ``path`` only when it is a JSON integer, else NULL."""
    return F.when(jtype(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def jbool(v: Column, path: str) -> Column:
    return F.when(jtype(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def jarray(v: Column, path: str) -> Column:
    """array<variant> at ``path`` when it is a JSON array, else NULL."""
    return F.when(jtype(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def unicode_trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it (higher-order functions evaluate anew what they name)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def system_prompt(body: Column) -> Column:
    """H6: trimmed ``system`` string, else content of the first ``system``-role message; NULL if blank."""
    return once(F.try_parse_json(body), system_prompt_v)


def system_prompt_v(v: Column) -> Column:
    """H6 on an already parsed (VARIANT) body."""
    msgs = jarray(v, "$.messages")
    first_sys = F.try_element_at(F.filter(msgs, lambda m: jstr(m, "$.role") == "system"), F.lit(1))
    text = F.coalesce(jstr(v, "$.system"), once(first_sys, lambda m: jstr(m, "$.content")))
    return once(unicode_trim(text), lambda t: F.when(F.length(t) > 0, t))


def fnv1a64_hex(s: Column) -> Column:
    """FNV-1a 64-bit of the UTF-8 bytes of ``s`` as 16 lower-case hex digits.

    Runs in-row with ``aggregate`` over the bytes (one character each in Latin-1),
    keeping the state as two 32-bit halves so that every product fits a signed 64-bit long (no
    overflow under ANSI mode): with m = (lo ^ b) * 435,
    lo' = m & 0xffffffff and hi' = (hi * 435 + lo_x * 256 + (m >> 32)) & 0xffffffff.
    ``s`` is evaluated once, and its bytes are told apart once, not at every step.
    """
    latin = F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")
    # the empty text splits into one empty piece, which is no byte
    chars = F.filter(F.split(latin, ""), lambda c: F.octet_length(c) > 0)
    init = F.struct(F.lit(FNV_OFFSET_HI).cast("long").alias("hi"), F.lit(FNV_OFFSET_LO).cast("long").alias("lo"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(acc, c):
        return once(acc["lo"].bitwiseXOR(F.ascii(c).cast("long")), lambda lo_x: F.struct(
            (acc["hi"] * F.lit(FNV_PRIME_LOW) + lo_x * F.lit(256) + F.shiftright(lo_x * F.lit(FNV_PRIME_LOW), 32)).bitwiseAND(mask).alias("hi"),
            (lo_x * F.lit(FNV_PRIME_LOW)).bitwiseAND(mask).alias("lo")))

    return F.aggregate(chars, init, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def prompt_hash(body: Column) -> Column:
    """H7: fingerprint of the system prompt (NULL when there is none)."""
    return fnv1a64_hex(system_prompt(body))


def redact(body: Column, fields: list[str]) -> Column:
    """H9: replace listed top-level keys of a JSON object with "[REDACTED]".

    No fields, NULL or text that is no JSON -> body unchanged. Valid JSON is
    re-serialised compactly, objects with sorted keys; of a key that an object
    repeats the last value counts. A body that looks like an object, cannot be
    parsed here and names a listed field is replaced whole by the marker: a
    listed value never stays because a body could not be read.
    """
    if not fields:
        return body
    v = F.try_parse_json(body)
    red = F.expr(f"CAST('{REDACTED}' AS VARIANT)")
    names = F.array(*[F.lit(f) for f in fields])
    obj = F.try_variant_get(v, "$", "map<string,variant>")
    out = F.to_json(F.transform_values(obj, lambda k, x: F.when(F.array_contains(names, k), red).otherwise(x)))
    named = F.lit(False)
    for f in fields:
        named = named | body.contains(f)
    # an escaped name (\\u006d...) is not found by its text
    suspect = v.isNull() & F.ltrim(body).startswith("{") & (named | body.contains("\\u"))
    return (F.when(jtype(v).startswith("OBJECT") & obj.isNotNull(), out)
            .when(suspect, F.lit(REDACTED)).when(v.isNotNull() & (jtype(v) != "VOID"), F.to_json(v)).otherwise(body))
