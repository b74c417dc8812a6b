"""``string.Template`` as a column: compiled to one concatenation where all values print alike on both sides."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def parts(template: str) -> list[tuple[str, str]]:
    """("text", literal) and ("name", placeholder) in order; a bare ``$`` raises ValueError."""
    out: list[tuple[str, str]] = []
    last = 0
    for m in string.Template.pattern.finditer(template):
        if m.start() > last:
            out.append(("text", template[last : m.start()]))
        last = m.end()
        if m["escaped"] is not None:
            out.append(("text", "$"))
        elif m["named"] or m["braced"]:
            out.append(("name", m["named"] or m["braced"]))
        else:
            raise ValueError(f"Invalid placeholder in string at position {m.start()}")
    if last < len(template):
        out.append(("text", template[last:]))
    return out


def _shown(df: DataFrame, name: str) -> Column:
    """A value as ``str()`` prints it; null as None."""
    kind = df.schema[name].dataType
    if isinstance(kind, _PLAIN):
        text = F.col(f"`{name}`").cast("string")
    elif isinstance(kind, T.BooleanType):
        text = F.when(F.col(f"`{name}`"), "True").otherwise("False")
        return F.when(F.col(f"`{name}`").isNull(), "None").otherwise(text)
    elif isinstance(kind, T.DateType):
        text = F.date_format(F.col(f"`{name}`"), "yyyy-MM-dd")
    elif isinstance(kind, T.DecimalType):
        text = F.col(f"`{name}`").cast("string")
    elif isinstance(kind, T.TimestampType):
        value = F.col(f"`{name}`")
        fine = F.when(F.date_format(value, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(value, "SSSSSS")))
        text = F.concat(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), fine, F.date_format(value, "xxx"))
    else:
        shown = F.udf(lambda v: str(v), "string")  # floats, arrays, structs: Python's own print
        return F.when(F.col(f"`{name}`").isNull(), "None").otherwise(shown(F.col(f"`{name}`")))
    return F.coalesce(text, F.lit("None"))


def format_column(df: DataFrame, template: str) -> Column:
    """The template filled with the columns of ``df`` ($chunk among them); an unknown name raises KeyError."""
    out = []
    for kind, value in parts(template):
        if kind == "name" and value not in df.columns:
            raise KeyError(value)
        out.append(F.lit(value) if kind == "text" else _shown(df, value))
    return F.concat(*out) if out else F.lit("")
