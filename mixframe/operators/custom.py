"""User scoring functions over batches of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mixframe.config import TableConfig

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def custom_scorer(fn: Scorer, out_schema: str | T.StructType) -> Callable[[DataFrame, TableConfig], DataFrame]:
    """An operator that applies ``fn`` to batches of feature columns and puts the id columns back on its rows.

    ``fn`` gets the declared features without ids and labels, and returns the columns of ``out_schema`` with one row
    for each input row, in order. It must not depend on where a batch starts or ends.
    """

    def run(df: DataFrame, config: TableConfig) -> DataFrame:
        ids = list(config.ids)
        columns = config.features
        predicted = T.StructType.fromDDL(out_schema) if isinstance(out_schema, str) else out_schema
        schema = T.StructType([df.schema[name] for name in ids] + list(predicted.fields))
        kinds = {field.name: field.type for field in to_arrow_schema(predicted)}

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                answer = fn(batch.select(columns).to_pandas())
                if len(answer) != batch.num_rows:
                    raise ValueError("a scorer must return one row for each input row")
                # ids never leave Arrow: a null beside them would turn large ones into floats
                held = [batch.column(batch.schema.get_field_index(name)) for name in ids]
                rest = [pa.Array.from_pandas(answer[name], type=kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([*held, *rest], names=[*ids, *kinds])

        return df.select(*ids, *columns).mapInArrow(scored, schema)

    return run
