"""Coercion of columns to declared types: exact or an error, never a silent loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LakeError

#: Unsigned and sized kinds that Spark has no type for, as field metadata: kind, or kind and size.
KIND, WIDTH = "strandlake.kind", "strandlake.width"
RANGES = {"uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}
CARRIERS = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0)}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LIMITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def fail_unless(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error naming ``message`` on rows where ``condition`` is false (null passes)."""
    return F.when(F.coalesce(condition, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)))


def coerce(value: Column, source: T.DataType, target: T.DataType, name: str = "value") -> Column:
    """``value`` of type ``source`` as ``target``.

    Integral targets take integral values of any numeric type and numeric text, range-checked; a
    fraction is an error. Text takes anything. Booleans take booleans alone. Floating-point takes any
    number, losses allowed. Decimals are range-checked and may round their fraction. Dates and
    timestamps take themselves and raw epoch numbers (days; milliseconds). Null stays null.
    """
    if source == target:
        return value
    if isinstance(target, T.StringType):
        return value.cast(target)
    if isinstance(target, _INTEGRAL):
        if isinstance(source, T.BooleanType):
            raise LakeError(f"cannot write boolean to {target.simpleString()} column {name}")
        if isinstance(source, _INTEGRAL):
            wide = value.cast("decimal(20,0)")
        elif isinstance(source, T.StringType):
            wide = value.cast("decimal(38,10)")
        else:
            wide = value.cast("double") if isinstance(source, (T.FloatType, T.DoubleType)) else value
        bound = 1 << _LIMITS[type(target)]
        number = value.cast("decimal(38,10)") if isinstance(source, T.StringType) else value
        exact = fail_unless(wide == F.floor(wide), f"not integral: {name}", number)
        if isinstance(source, (T.FloatType, T.DoubleType)):
            exact = fail_unless((wide >= -float(bound)) & (wide < float(bound)), f"out of range: {name}", exact)
        else:
            exact = fail_unless((wide >= F.lit(-bound).cast("decimal(20,0)")) & (wide < F.lit(str(bound)).cast("decimal(20,0)")), f"out of range: {name}", exact)
        return exact.cast(target)
    if isinstance(target, T.BooleanType):
        raise LakeError(f"cannot write {source.simpleString()} to boolean column {name}")
    if isinstance(target, T.BinaryType) and not isinstance(source, T.StringType):
        raise LakeError(f"cannot write {source.simpleString()} to binary column {name}")
    if isinstance(target, T.DateType) and isinstance(source, _INTEGRAL):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(target, T.TimestampType) and isinstance(source, _INTEGRAL):
        return F.timestamp_millis(value.cast("long"))
    return value.cast(target)


def unsigned(value: Column, kind: str, name: str = "value") -> Column:
    """``value`` as an unsigned integer of ``kind``, in the next wider signed type."""
    low, high = RANGES[kind]
    wide = value.cast("decimal(38,0)")
    return fail_unless((wide >= F.lit(low)) & (wide <= F.lit(str(high)).cast("decimal(20,0)")), f"out of range for {kind}: {name}", wide).cast(CARRIERS[kind])


def fixed_width(value: Column, width: int, name: str = "value") -> Column:
    """Binary of exactly ``width`` bytes."""
    return fail_unless(F.octet_length(value) == width, f"not {width} bytes: {name}", value)


def fixed_list(value: Column, size: int, name: str = "value") -> Column:
    """A list of exactly ``size`` elements."""
    return fail_unless(F.size(value) == size, f"not {size} elements: {name}", value)
