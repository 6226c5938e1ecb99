"""String clean-up over whole schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column; other columns pass through unchanged."""
    return df.select(
        *[
            F.trim(F.col(field.name)).alias(field.name)
            if isinstance(field.dataType, StringType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )
