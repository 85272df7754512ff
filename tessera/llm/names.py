"""Column names of any kind, quoted and not yet taken; and a table to release with another one."""

from __future__ import annotations

from pyspark.sql import DataFrame


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, stem: str) -> str:
    """stem, after as many underscores as no column of df begins with."""
    return "_" * max((len(c) - len(c.lstrip("_")) + 1 for c in df.columns), default=1) + stem


def holding(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which reads a scratch table; release(df) drops that table."""
    df._scratch = table._scratch
    return df
