"""Words of whole texts as numpy arrays, from the Arrow batches Spark hands to a task.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A batch is cut into
slices of a quarter megabyte (a longer text is a slice of its own), so that a
task's memory depends on the longest text and not on the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tessera.session import configure

SLICE_BYTES = 1 << 18
# long texts make large batches; these keep what lies between Spark and a task's Python small
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD1342543DE82EF95)
_GRAM_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def configure_for_texts(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits; one-to-one for a given salt."""
    x = x + np.uint64((salt * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, kept for the next slice."""
    have = _powers.get(int(base))
    if have is None or len(have) < count:
        steps = np.full(max(count, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if count <= SLICE_BYTES + 1:
            _powers[int(base)] = have
    return have[:count]


def run_hashes(values: np.ndarray, base: np.uint64, inverse: np.uint64, starts, ends) -> np.ndarray:
    """Hash of values[start:end] for every pair, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts])


class Words:
    """The words of a slice of texts.

    ``first[r]:first[r + 1]`` are the words of text ``r``; ``starts`` and
    ``ends`` are byte positions in ``data``, where text ``r`` lies in
    ``offsets[r]:offsets[r + 1]``.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        word = np.zeros(len(self.data) + 1, bool)
        word[:-1] = ~_BLANK[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge))
        self.ends = np.flatnonzero(before & (~word | edge))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash per word; ``lower`` reads A-Z as a-z."""
        table = _LOWER_BYTE if lower else _BYTE
        return run_hashes(table[self.data], _ODD, _ODD_INVERSE, self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """First word of every run of ``size`` words inside one text."""
        at = np.arange(len(self.starts))
        return at[at + size <= np.repeat(self.first[1:], self.counts)]

    def gram_hashes(self, word_hashes: np.ndarray, at: np.ndarray, size) -> np.ndarray:
        """Hash of the words at[i], ..., at[i] + size - 1; ``size`` may differ per run."""
        return run_hashes(word_hashes, _GRAM, _GRAM_INVERSE, at, at + size)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text, or one row."""
    column = batch.column(text)
    lengths = np.zeros(len(column), np.int64)
    if len(column):
        lengths[:] = pc.binary_length(column.cast(pa.large_string()).fill_null("")).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def per_slice(fn: Callable[[pa.RecordBatch, Words], Iterator[pa.RecordBatch] | pa.RecordBatch | None], text: str = "text"):
    """A function for ``mapInArrow`` that calls ``fn(rows, words)`` for every slice."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives back what a batch has used
        for batch in batches:
            for part in slices(batch, text):
                out = fn(part, Words(part.column(text)))
                if out is not None:
                    yield out

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), then those of starts[1], and so on."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def list_column(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    """A list column whose row ``r`` holds the next ``counts[r]`` values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the longs Spark stores."""
    return x.view(np.int64)
