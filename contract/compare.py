"""Compare contract queries with their SQL on the same files.

    python -m contract.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from contract.queries import ORACLES, QUERIES


def expected_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection.execute(sql).df()


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        values = frame[column]
        if pd.api.types.is_bool_dtype(values):
            frame[column] = values.astype(str)
        elif pd.api.types.is_numeric_dtype(values):
            frame[column] = values.astype(float)
        elif pd.api.types.is_datetime64_any_dtype(values):
            frame[column] = values.dt.strftime("%Y-%m-%d %H:%M:%S.%f")
        else:
            frame[column] = values.map(
                lambda v: None if v is None or v is pd.NaT or v != v
                else f"{v} 00:00:00.000000" if type(v).__name__ == "date" else str(v)
            )
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def compare(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, str]:
    """Row count and 'same', 'rows only' or a description of the difference."""
    actual = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return len(actual), "rows only"
    expected = expected_rows(sf_dir, ORACLES[name])
    if sorted(actual.columns) != sorted(expected.columns):
        return len(actual), f"columns {sorted(actual.columns)} / {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return len(actual), f"rows {len(actual)} / {len(expected)}"
    left, right = _canonical(actual), _canonical(expected)
    for column in left.columns:
        differing = ~((left[column] == right[column]) | (left[column].isna() & right[column].isna()))
        if differing.any():
            at = differing.idxmax()
            return len(actual), (
                f"{int(differing.sum())} differences in {column}: "
                f"{left.loc[at].to_dict()} / {right.loc[at].to_dict()}"
            )
    return len(actual), "same"


def main(arguments: list[str]) -> int:
    from ledgerlake.session import build_session

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", spark__master="local[8]", spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    failures = 0
    for name in arguments[1:] or list(QUERIES):
        start = time.time()
        try:
            rows, outcome = compare(spark, sf_dir, name)
        except Exception as error:
            rows, outcome = -1, f"error {str(error)[:1500]}"
        failures += outcome not in ("same", "rows only")
        print(f"{name:32s} {rows:8d} {time.time() - start:6.1f}s {outcome}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
