"""Where a model outside this library plugs in: its callable runs on Arrow batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def apply_model(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, key: str | None = None) -> DataFrame:
    """make() loads the model once for each task; the callable gets batches. A batch that fails runs row by row.

    schema: the model's columns. A column `error` is added: null where the model gave a row. A row that fails gives one with
    its key (if a key column is named), nulls, and the error's text, so no row of the input is lost.
    """
    fields = T._parse_datatype_string(schema)
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            try:
                yield model(batch)[names].assign(error=None)
            except Exception:  # noqa: BLE001  a model's failure on a batch is expected, and tried row by row
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    try:
                        yield model(row)[names].assign(error=None)
                    except Exception as e:  # noqa: BLE001
                        empty = {n: [row[key].iloc[0] if n == key else None] for n in names}
                        yield pd.DataFrame({**empty, "error": [f"{type(e).__name__}: {e}"[:1000]]}, dtype=object)

    return df.mapInPandas(run, T.StructType([*fields, T.StructField("error", T.StringType())]))
