"""Words of whole texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewatch.llm.common import runs_of_text

#: Text that is cut into words at once.
SLICE_BYTES = 4_000_000


@dataclass
class Words:
    """Texts as codes of a word list."""

    codes: np.ndarray
    starts: np.ndarray  # of each text, and the total
    words: pa.Array  # binary

    def text(self, i: int) -> slice:
        return slice(self.starts[i], self.starts[i + 1])


def words_of(texts: pa.Array) -> Words:
    """Words are runs without the six ASCII space characters, A-Z in lower case."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower needs offsets that start at 0
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = split.flatten()
    starts = split.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # outer space leaves empty parts
    if not full.all():
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(), starts, coded.dictionary.cast(pa.large_binary()))


def in_slices(batch: pa.RecordBatch | pa.Table, column: str = "text") -> Iterator[tuple[pa.RecordBatch | pa.Table, Words]]:
    """The batch in slices of ``SLICE_BYTES``, each with its words."""
    for part in runs_of_text(pc.binary_length(batch.column(column)).to_pylist(), SLICE_BYTES):
        piece = batch.slice(part.start, part.stop - part.start)
        texts = piece.column(column)
        yield piece, words_of(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
