"""Arrow batches in parts, so that what Python holds doesn't grow with a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def in_parts(work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, called with ``rows`` rows at most; no part is held while the next batch is read."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for i in range(0, whole.num_rows, rows):
                yield whole.slice(i, rows)
            del whole

    return lambda it: map(work, parts(it))


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Where lists of these lengths begin, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
