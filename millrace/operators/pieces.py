"""Arrow batches in pieces, so that Python holds the objects of a few rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of rows that a task turns into Python objects at a time.
PIECE_BYTES = 1 << 20


def _row_bytes(column):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        flat = column.flatten()
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) * (flat.nbytes / max(len(flat), 1))
    return np.full(len(column), column.nbytes / max(len(column), 1))


def pieces(batch, step: int = 1, most: int = PIECE_BYTES) -> Iterator:
    """Slices of a batch in order, each of a multiple of ``step`` rows (the last one of what is
    left) and of at most ``most`` bytes, unless ``step`` rows have more."""
    import numpy as np

    ends = np.cumsum(sum(_row_bytes(c) for c in batch.columns)) if batch.num_columns else np.zeros(batch.num_rows)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at
        n = max(fits // step * step, step) if at + fits < batch.num_rows else fits
        yield batch.slice(at, n)
        at += n
