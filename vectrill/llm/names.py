"""Column names that can't clash with those of a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores in front as make it differ from all ``columns``, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` but for those that are called like one of ``names``."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]
