"""Words of many texts at once, by Arrow kernels: A-Z lower-cased, then all runs of digits, letters and what is beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import whole_text

#: What lies between words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are cut into words at a time; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000


def id_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id (null stays null) and text (null: empty), whatever else the table has."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), whole_text(f"`{text}`").alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text."""
    for batch in batches:
        filled = np.cumsum(np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(filled[1:] != filled[:-1]) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, the words of all texts in turn as indices, and the distinct words that these point to."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=GAP)
    flat, owner = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return np.bincount(owner[np.asarray(full.to_numpy(zero_copy_only=False))], minlength=len(texts)), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values that hold counts[i] of the values each, in turn."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
