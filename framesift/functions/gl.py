"""Reading the parameters of buffer calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions.text import as_long, capture

# Buffer targets by name and by the number used for them in traces.
TARGETS = {
    "0x8892": "GL_ARRAY_BUFFER",
    "0x8D40": "GL_ELEMENT_ARRAY_BUFFER",
    "0x88B8": "GL_PIXEL_PACK_BUFFER",
    "0x88B9": "GL_PIXEL_UNPACK_BUFFER",
    "0x8B11": "GL_UNIFORM_BUFFER",
    "0x8C8A": "GL_TRANSFORM_FEEDBACK",
    "0x8B8F": "GL_COPY_READ_BUFFER",
    "0x8B8E": "GL_COPY_WRITE_BUFFER",
    "0x8F3F": "GL_DRAW_INDIRECT_BUFFER",
    "0x90D2": "GL_SHADER_STORAGE_BUFFER",
}
DEFAULT_TARGET = "GL_ARRAY_BUFFER"

# Usage hints by number.
USAGES = {
    "0x88E0": "GL_STREAM_DRAW",
    "0x88E4": "GL_STATIC_DRAW",
    "0x88E8": "GL_DYNAMIC_DRAW",
    "0x88E1": "GL_STREAM_READ",
    "0x88E5": "GL_STATIC_READ",
    "0x88E9": "GL_DYNAMIC_READ",
    "0x88E2": "GL_STREAM_COPY",
    "0x88E6": "GL_STATIC_COPY",
    "0x88EA": "GL_DYNAMIC_COPY",
}


def _named(c: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def target_name(c: Column) -> Column:
    """Name of a buffer target; an unknown text stays as it is."""
    return _named(c, TARGETS)


def target_number(c: Column) -> Column:
    """Number of a named buffer target; an unknown text stays as it is."""
    return _named(c, {name: number for number, name in TARGETS.items()})


def usage_name(c: Column) -> Column:
    return _named(c, USAGES)


def is_target_name(c: Column) -> Column:
    return c.isin(sorted(TARGETS.values()))


def tokens(params: Column) -> Column:
    """Parameters split at blanks, tabs and commas. Inside brackets these do not
    split and are left out."""
    found = F.regexp_extract_all(params, F.lit(r"(?:[^ \t,(\[]|[(\[][^)\]]*[)\]]?)+"), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(t, r"[ \t,]", ""))


def number(token: Column) -> Column:
    """Leading ``0x`` number or leading decimal number of a token, else 0."""
    # More than 16 digits do not fit; such a token is read as the decimal 0 before its x.
    hex_digits = capture(token, r"^0x[+-]?0*([0-9a-fA-F]{1,16})(?![0-9a-fA-F])")
    sign = F.when(token.startswith("0x-"), -1).otherwise(1)
    return F.coalesce(
        F.when(hex_digits != "", F.conv(hex_digits, 16, 10).try_cast("bigint") * sign).otherwise(
            as_long(capture(token, r"^([+-]?\d+)"))
        ),
        F.lit(0),
    )


def id_of(token: Column) -> Column:
    """Buffer id of a generating or deleting call: a ``0x`` is dropped first, so the rest
    is read as decimal."""
    bare = F.when(
        (F.length(token) > 2) & (token.startswith("0x") | token.startswith("0X")),
        F.substring(token, F.lit(3), F.length(token)),
    ).otherwise(token)
    return number(bare)
