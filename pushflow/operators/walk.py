"""Sequential rules: the rows of a lane, in order, each seeing the state that the ones before left."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def walked(rows: DataFrame, lane: str, order: list[str], given: list[str], begin: Callable[[], list], step: Callable, kept: list[str], out: str) -> DataFrame:
    """rows, sorted within each lane, through step(state, *given), which changes the state and returns one value.

    Returns the lane, the kept columns and the values; out is their name and type. Lanes are dealt
    to partitions and sorted there, which spills where it must; the walk holds one Arrow batch and
    the state of one lane, however long the lane is.
    """
    columns = list(dict.fromkeys([lane, *kept, *given]))
    sorted_ = rows.repartition(lane).sortWithinPartitions(lane, *order).select(*columns)
    name, kind = out.split(" ")
    schema = sorted_.select(lane, *kept).schema.add(name, kind)

    def work(batches):
        now, state = object(), begin()
        for batch in batches:
            values = [batch.column(columns.index(c)).to_pylist() for c in given]
            said = []
            for own, *x in zip(batch.column(0).to_pylist(), *values, strict=True):
                if own != now:
                    now, state = own, begin()
                said.append(step(state, *x))
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in (lane, *kept)), pa.array(said)], names=[lane, *kept, name])

    return sorted_.mapInArrow(work, schema)
