"""String helpers shared by the other modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Drop Unicode white space at both ends (``trim`` drops blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def label(c: Column) -> Column:
    """``single_table`` -> ``Single table``: only the first letter is raised."""
    words = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def _quoted(c: Column) -> Column:
    """A JSON string literal; null becomes ``null``."""
    inner = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substr(inner, F.lit(2), F.length(inner) - 2)


def json_text(c: Column, dtype: T.DataType) -> Column:
    """JSON with a blank after ``,`` and ``:`` and nulls kept.

    ``to_json`` prints the compact form and drops null fields, chat templates
    expect the spaced one. The expression is built from the type once per plan.
    """
    if isinstance(dtype, T.StructType):
        parts = [
            F.concat(F.lit(f'"{f.name}": '), json_text(c.getField(f.name), f.dataType))
            for f in dtype.fields
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: json_text(x, dtype.elementType))
        body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        items = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                _quoted(e["key"].cast("string")), F.lit(": "), json_text(e["value"], dtype.valueType)
            ),
        )
        body = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    else:
        return _quoted(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(body)
