"""Names of added columns, and rows kept apart from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, with underscores after it while one of the tables has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(df: DataFrame) -> DataFrame:
    """df as one column "row", beside which helper columns can have any names."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def row_columns(df: DataFrame) -> list[Column]:
    """The columns of df, out of "row"."""
    return [F.col("row").getField(c).alias(c) for c in df.columns]
