"""State of a group of a stream as one value of columns.

An exchange with the state store for each row takes far longer than the row, so a group's rows are
read and written together, once a micro-batch.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa

#: the columns as an Arrow stream, and the timer that is registered
STATE = "rows binary, timer long"


def pack(rows: list[tuple], schema: pa.Schema) -> bytes:
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(bytes(data)).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns)))


def cells(frame: pd.DataFrame, *names: str):
    """Rows of the named columns."""
    return zip(*(frame[n].tolist() for n in names))
