"""Hook for outside decisions over rows, such as a model's.

A decider gets batches of rows and returns typed rows; Spark spreads the batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditlake.sources.text import validate_records


def decide(df: DataFrame, key: str, text: str, fn: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Answer text per row: ``key, answer``."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "answer": fn(batch["text"])})

    return df.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInPandas(run, f"key {kind}, answer string")


def decided_records(
    df: DataFrame, key: str, text: str, fn: Callable[[pd.Series], pd.Series], schema: T.StructType, required: list[str]
) -> DataFrame:
    """Answers parsed and checked: ``key, answer, record, problem, valid``."""
    return validate_records(decide(df, key, text, fn), "answer", schema, required)
