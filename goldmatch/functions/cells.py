"""Cell rules: when are two result cells the same?

``1`` equals ``1.0``, null equals null, ``'1'`` differs from ``1``, doubles are
equal when they agree after rounding to four decimals, text is compared without
white space at its ends. Results of different types cannot be unioned as they
are, so a cell becomes a tagged text (``n:`` number, ``s:`` text, ``b:`` bytes)
and a row becomes an array of those. Further tags: ``i:`` interval, ``a:`` array,
``m:`` map, ``t:`` struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldmatch.functions.numbers import round_exact
from goldmatch.functions.text import strip

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType, T.AnyTimeType)
_DIGITS = 4
_LONG, _DECIMAL = float(2**63), 1e38  # whole doubles below these have all their digits in the type


def normalize_value(c: Column, dtype: T.DataType) -> Column:
    """The typed rule: reals and decimals rounded to four decimals, text stripped, rest
    kept; the same inside arrays, structs and the values of maps."""
    if isinstance(dtype, _REAL):
        return round_exact(c.cast("double"), _DIGITS)
    if isinstance(dtype, T.DecimalType):
        return _rounded_decimal(c, dtype)
    if isinstance(dtype, _TEXT):
        return strip(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: normalize_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: normalize_value(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [normalize_value(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _rounded_decimal(c: Column, dtype: T.DecimalType) -> Column:
    return F.bround(c, _DIGITS) if dtype.scale > _DIGITS else c


def _plain(decimal: Column) -> Column:
    """Text of a decimal without zeros at the end of its fraction."""
    text = decimal.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _real_text(x: Column) -> Column:
    """Text of a rounded double, the same as that of an equal integer or decimal."""
    size = F.abs(x)
    whole = (size < F.lit(_LONG)) & (F.floor(x).cast("double") == x)
    return (
        F.when(whole, x.cast("long").cast("string"))
        .when(size < F.lit(_LONG), _plain(x.cast(T.DecimalType(38, _DIGITS))))
        .when(size < F.lit(_DECIMAL), _plain(x.cast(T.DecimalType(38, 0))))
        .otherwise(x.cast("string"))
    )


def canonical_cell(c: Column, dtype: T.DataType) -> Column:
    """Tagged text of one cell; null stays null.

    Numbers of all types agree when their values do: decimals keep their digits, whole
    doubles print as integers. Intervals compare by length within their family, times and
    dates by their ISO text. Nested values are JSON of their elements' own tagged texts, so
    the rules hold at every depth; structs go by position, maps by their sorted entries.
    """
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(dtype, _INTEGRAL):
        return F.concat(F.lit("n:"), c.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("n:1")).when(~c, F.lit("n:0"))
    if isinstance(dtype, T.DecimalType):
        return F.concat(F.lit("n:"), _plain(_rounded_decimal(c, dtype)))
    if isinstance(dtype, _REAL):
        return F.concat(F.lit("n:"), _real_text(round_exact(c.cast("double"), _DIGITS)))
    if isinstance(dtype, _TEXT):
        return F.concat(F.lit("s:"), strip(c))
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("b:"), F.hex(c))
    if isinstance(dtype, _TIME):
        return F.concat(F.lit("s:"), c.cast("string"))
    if isinstance(dtype, T.DayTimeIntervalType):
        return F.concat(F.lit("i:"), c.cast("interval day to second").cast("string"))
    if isinstance(dtype, T.YearMonthIntervalType):
        return F.concat(F.lit("i:"), c.cast("interval year to month").cast("string"))
    if isinstance(dtype, T.ArrayType):
        return F.concat(F.lit("a:"), F.to_json(F.transform(c, lambda x: canonical_cell(x, dtype.elementType))))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c), lambda e: F.array(canonical_cell(e["key"], dtype.keyType), canonical_cell(e["value"], dtype.valueType))
        )
        return F.concat(F.lit("m:"), F.to_json(F.array_sort(entries)))
    if isinstance(dtype, T.StructType):
        fields = F.array(*[canonical_cell(c.getField(f.name), f.dataType) for f in dtype.fields])
        return F.when(c.isNotNull(), F.concat(F.lit("t:"), F.to_json(fields)))
    return F.concat(F.lit("s:"), c.cast("string"))


def canonical_row(columns: Sequence[Column], dtypes: Sequence[T.DataType]) -> Column:
    """Row key: the cells in column order."""
    return F.array(*[canonical_cell(c, t) for c, t in zip(columns, dtypes)])


def canonical_frame(df: DataFrame, by_name: bool = False) -> DataFrame:
    """``df`` as one column ``cells``; ``by_name`` puts columns in name order first."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    order = range(len(names))
    if by_name:
        order = sorted(order, key=lambda i: (names[i].lower(), i))
    types = [f.dataType for f in df.schema.fields]
    return plain.select(
        canonical_row([F.col(f"_{i}") for i in order], [types[i] for i in order]).alias("cells")
    )


def cells_by_name(named: Column) -> Column:
    """``ARRAY<STRUCT<name, cell>>`` to cells in name order."""
    ordered = F.array_sort(
        F.transform(
            named,
            lambda x: F.struct(F.lower(x["name"]).alias("name"), x["cell"].alias("cell")),
        )
    )
    return F.transform(ordered, lambda x: x["cell"])
