"""Selectors: predicates on row ids, combined by boolean algebra.

Those that are expressions of the id go into the scan; a batch of ids is a semi join, for which the optimizer may make
a Bloom filter. Any selector can be used with any search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Selector:
    """Subclasses give a predicate, or override ``apply`` for what only a join can do."""

    def predicate(self, id: Column) -> Column:
        raise NotImplementedError(f"{type(self).__name__} can't be an expression; it can only be applied to a table")

    def apply(self, df: DataFrame, id: str = "id") -> DataFrame:
        return df.where(self.predicate(F.col(id)))

    def __invert__(self) -> Selector:
        return Not(self)

    def __and__(self, other: Selector) -> Selector:
        return And(self, other)

    def __or__(self, other: Selector) -> Selector:
        return Or(self, other)

    def __xor__(self, other: Selector) -> Selector:
        return Xor(self, other)


@dataclass
class All(Selector):
    def predicate(self, id: Column) -> Column:
        return F.lit(True)


@dataclass
class IdRange(Selector):
    """``low <= id < high``."""

    low: int
    high: int

    def predicate(self, id: Column) -> Column:
        return (id >= self.low) & (id < self.high)


@dataclass
class IdArray(Selector):
    """A short list of ids."""

    ids: list[int]

    def predicate(self, id: Column) -> Column:
        return id.isin(self.ids)


@dataclass
class IdBatch(Selector):
    """Ids in a table with the column ``id``."""

    ids: DataFrame

    def apply(self, df: DataFrame, id: str = "id") -> DataFrame:
        wanted = self.ids.select(F.col("id").alias("_selected"))
        return df.join(wanted, df[id] == wanted["_selected"], "left_semi")


@dataclass
class IdBitmap(Selector):
    """Bit id % 8 of byte id div 8; ids beyond the bytes are not selected."""

    bitmap: bytes

    def predicate(self, id: Column) -> Column:
        byte = F.element_at(F.array(*[F.lit(b) for b in self.bitmap]), F.least(F.floor(id / 8), F.lit(len(self.bitmap) - 1)).cast("int") + 1)
        inside = (id >= 0) & (id < 8 * len(self.bitmap))
        return F.when(inside, F.call_function("shiftright", byte, F.pmod(id, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1).otherwise(F.lit(False))


@dataclass
class Not(Selector):
    of: Selector

    def predicate(self, id: Column) -> Column:
        return ~self.of.predicate(id)

    def apply(self, df: DataFrame, id: str = "id") -> DataFrame:
        if isinstance(self.of, IdBatch):
            wanted = self.of.ids.select(F.col("id").alias("_selected"))
            return df.join(wanted, df[id] == wanted["_selected"], "left_anti")
        return super().apply(df, id)


def flagged(df: DataFrame, selector: Selector, id: str, name: str) -> DataFrame:
    """``df`` with a column that tells whether the selector takes a row; batches of ids become an outer join."""
    if isinstance(selector, IdBatch):
        wanted = selector.ids.select(F.col("id").alias(f"{name}_id")).where(F.col(f"{name}_id").isNotNull()).distinct()
        joined = df.join(wanted, F.col(id) == F.col(f"{name}_id"), "left")
        return joined.withColumn(name, F.col(f"{name}_id").isNotNull()).drop(f"{name}_id")
    if isinstance(selector, Not):
        return flagged(df, selector.of, id, name).withColumn(name, ~F.col(name))
    if isinstance(selector, Translated):
        return flagged(df, selector.of, selector.column, name)
    if isinstance(selector, _Both):
        sides = flagged(flagged(df, selector.left, id, f"{name}l"), selector.right, id, f"{name}r")
        return sides.withColumn(name, selector.joined(F.col(f"{name}l"), F.col(f"{name}r"))).drop(f"{name}l", f"{name}r")
    return df.withColumn(name, F.coalesce(selector.predicate(F.col(id)), F.lit(False)))


class _Both(Selector):
    def __init__(self, left: Selector, right: Selector):
        self.left, self.right = left, right

    def joined(self, left: Column, right: Column) -> Column:
        raise NotImplementedError

    def predicate(self, id: Column) -> Column:
        return self.joined(self.left.predicate(id), self.right.predicate(id))

    def apply(self, df: DataFrame, id: str = "id") -> DataFrame:
        try:
            return super().apply(df, id)
        except NotImplementedError:  # a batch within
            name = "_selected"
            while any(c.startswith(name) for c in df.columns):
                name = "_" + name
            return flagged(df, self, id, name).where(name).drop(name)


class And(_Both):
    def joined(self, left: Column, right: Column) -> Column:
        return left & right

    def apply(self, df: DataFrame, id: str = "id") -> DataFrame:
        return self.right.apply(self.left.apply(df, id), id)


class Or(_Both):
    def joined(self, left: Column, right: Column) -> Column:
        return left | right


class Xor(_Both):
    def joined(self, left: Column, right: Column) -> Column:
        return left != right


@dataclass
class Translated(Selector):
    """A selector over external ids that stand in another column."""

    of: Selector
    column: str

    def apply(self, df: DataFrame, id: str = "id") -> DataFrame:
        return self.of.apply(df, self.column)


@dataclass
class Callback(Selector):
    """Any function of the id column, or a Python or pandas UDF."""

    function: Callable[[Column], Column]

    def predicate(self, id: Column) -> Column:
        return self.function(id)
