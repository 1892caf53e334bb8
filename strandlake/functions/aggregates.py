"""The aggregate functions: COUNT, SUM, MIN, MAX, each with an input, an output and perhaps an output type.

Every aggregate splits into a partial state and a merge, so batches combine exactly: integral sums
are kept in decimals, and only the result must fit the output column.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LakeError
from .coerce import coerce


class Aggregate(Enum):
    COUNT = "count"
    SUM = "sum"
    MIN = "min"
    MAX = "max"


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Aggregation:
    """``function`` of column ``input`` as column ``output``, in ``type`` or else the function's own type.

    COUNT counts rows, nulls too, as BIGINT. SUM, MIN and MAX skip nulls and are null if there is
    nothing else; their own type is the input's. MIN and MAX order text and bytes by bytes.
    """

    input: str
    output: str
    function: Aggregate
    type: T.DataType | None = None

    def result_type(self, schema: T.StructType) -> T.DataType:
        if self.type is not None:
            return self.type
        return T.LongType() if self.function is Aggregate.COUNT else schema[self.input].dataType

    def state_type(self, schema: T.StructType) -> T.DataType:
        kind = schema[self.input].dataType
        if self.function is Aggregate.COUNT:
            return T.LongType()
        if self.function is Aggregate.SUM:
            if isinstance(kind, _INTEGRAL):
                return T.DecimalType(38, 0)
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                return T.DoubleType()
            if isinstance(kind, T.DecimalType):
                return T.DecimalType(38, kind.scale)
            raise LakeError(f"SUM needs numbers: {self.input} is {kind.simpleString()}")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise LakeError(f"{self.function.name} needs comparable values: {self.input} is {kind.simpleString()}")
        return kind

    def partial(self, schema: T.StructType) -> Column:
        """The state of a group of input rows."""
        state = self.state_type(schema)
        if self.function is Aggregate.COUNT:
            return F.count(F.lit(1))
        if self.function is Aggregate.SUM:
            kind = schema[self.input].dataType
            # decimal(20,0) sums as decimal(30,0): ten billion rows of BIGINT before it could overflow.
            value = F.col(self.input).cast("decimal(20,0)") if isinstance(kind, _INTEGRAL) else F.col(self.input).cast("double") if isinstance(state, T.DoubleType) else F.col(self.input)
            return F.sum(value).cast(state)
        return (F.min if self.function is Aggregate.MIN else F.max)(self.input)

    def merged(self, name: str) -> Column:
        """The state of a group of states."""
        return {Aggregate.COUNT: F.sum, Aggregate.SUM: F.sum, Aggregate.MIN: F.min, Aggregate.MAX: F.max}[self.function](name)

    def result(self, state: Column, schema: T.StructType) -> Column:
        """The output of a state, range-checked."""
        return coerce(state, self.state_type(schema), self.result_type(schema), self.output)
