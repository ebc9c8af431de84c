"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Every run of three bytes falls into one of ``buckets`` hashed buckets. Two
multinomials over the buckets are counted, one over the trusted documents and
one over all documents. A text's score is the mean, over its n-grams, of
log p(bucket | trusted) - log p(bucket | raw); a document is kept if its score
reaches the threshold and no base rule fails. Nothing is drawn at random.

Memory per task is a few arrays of ``buckets`` numbers; the model that reaches
the driver has ``buckets`` rows whatever the corpus. Only counts are shuffled.

Null text counts as an empty one: no words, base rule failed, not kept. A row
is judged by its text alone, so repeated rows and repeated ids get equal
verdicts. Without trusted documents every score is 0 and the threshold has no
effect. Columns of the input besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, mix, per_slice

BUCKETS = 1 << 16
GRAM_BYTES = 3
# lowest mean log-likelihood ratio per n-gram of a kept document
THRESHOLD = -0.25
# most labelled documents the trusted model is fitted on
TRUSTED_ROWS = 20_000
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MULTIPLIER = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Ratio:
    """Log-likelihood ratio of each bucket, and the lowest mean that is kept."""

    weights: np.ndarray
    threshold: float


def gram_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every three-byte run, and the number of runs in each text."""
    data = words.data.astype(np.uint32)
    lengths = np.diff(words.offsets)
    counts = np.maximum(lengths - (GRAM_BYTES - 1), 0)
    if len(data) < GRAM_BYTES:
        return np.zeros(0, np.int64), counts
    grams = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    codes = ((grams * _MULTIPLIER) >> np.uint32(7)) % np.uint32(buckets)
    inside = np.ones(len(codes), bool)
    for back in range(1, GRAM_BYTES):  # runs that would cross the end of a text
        at = words.offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return codes[inside].astype(np.int64), counts


def _count(buckets: int):
    def run(batches):
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)

        def add(part: pa.RecordBatch, words: Words) -> None:
            codes, counts = gram_buckets(words, buckets)
            raw[:] += np.bincount(codes, minlength=buckets)
            chosen = np.repeat(part.column("trusted").to_numpy(zero_copy_only=False).astype(bool), counts)
            if chosen.any():
                trusted[:] += np.bincount(codes[chosen], minlength=buckets)

        for _ in per_slice(add)(batches):
            pass
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int64)), pa.array(raw[seen]), pa.array(trusted[seen])], ["bucket", "raw", "trusted"]
        )

    return run


def fit_ratio(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS,
              threshold: float = THRESHOLD, smoothing: float = 1.0) -> Ratio:
    """Count both multinomials over all of ``docs``.

    ``trusted`` has the doc_id of trusted documents; the ``rows`` of them that
    are first by hash make the target model, all documents the raw one.
    """
    ids = (
        trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("trusted", F.lit(True))
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")  # at most ``rows`` ids
    counted = (
        marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(_count(buckets), "bucket long, raw long, trusted long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, n, t in counted.collect():
        raw[bucket], target[bucket] = n, t
    if not target.any():
        return Ratio(np.zeros(buckets), threshold)
    weights = np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log(
        (raw + smoothing) / (raw.sum() + smoothing * buckets)
    )
    return Ratio(weights, threshold)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(words: Words, size: int = 5) -> np.ndarray:
    """Words of each text in windows of ``size`` words that the text has twice or more."""
    at = words.windows(size)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        grams = words.gram_hashes(words.hashes(), at, size)
        own = mix(grams + mix(words.rows()[at].astype(np.uint64), 3))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered[at[twice]] += 1
        covered[at[twice] + size] -= 1
    return _per_text(np.cumsum(covered[:-1]) > 0, words.first)


def repeated_lines(words: Words) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier line."""
    out = np.zeros(len(words.counts), np.int64)
    raw = words.data.tobytes()
    for r, (start, end) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())):
        lines = [line for line in raw[start:end].split(b"\n") if line and not line.isspace()]
        out[r] = len(lines) - len(set(lines))
    return out


def measures(words: Words, ratio: Ratio) -> dict[str, np.ndarray]:
    """The base measures, the score and the verdict of every text of a slice."""
    word_bytes = _per_text(np.ones(len(words), np.int64), words.first)
    codes, counts = gram_buckets(words, len(ratio.weights))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0.0], np.cumsum(ratio.weights[codes])])
    score = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(counts, 1)
    blank = np.isin(words.data, [0x20, *range(0x09, 0x0E)])
    letters = ((words.data & 0xC0) != 0x80) & ~blank
    repeated = repeated_words(words)
    failed = (word_bytes < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * word_bytes)
    return {
        "n_words": word_bytes,
        "word_chars": _per_text(letters, words.offsets),
        "n_symbols": _per_text(_SYMBOLS[words.data], words.offsets),
        "n_dup_lines": repeated_lines(words),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "score": score,
        "kept": ~failed & (score >= ratio.threshold),
    }


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def judge(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """(doc_id, measures, score, kept) for every row of ``docs``."""

    def rows(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        found = measures(words, ratio)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *[pa.array(v) for v in found.values()]], ["doc_id", *found]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_slice(rows), f"doc_id {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that ``judge`` keeps."""

    def rows(part: pa.RecordBatch, words: Words) -> Iterator[pa.RecordBatch]:
        return part.filter(pa.array(measures(words, ratio)["kept"]))

    return docs.mapInArrow(per_slice(rows), docs.schema)
