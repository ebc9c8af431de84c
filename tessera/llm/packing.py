"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokenised documents in hashed order. A round gives
each queue a credit of ``window`` tokens times its target share; a queue is
served whole multiples of ``least`` tokens of the credit it has gathered, and
what is left is its deficit, carried into the next round. A queue that runs dry
leaves its share to the others. The rounds' tokens follow one another and are
cut into sequences of ``window`` tokens, so every sequence holds the target
shares up to ``least`` tokens a queue.

What a queue has been served before round r is a function of r, the sizes and
the weights alone (``Schedule``), so a task that holds a document finds its
pieces, their sequences and the deficits at that point without the rounds
before: deficits pass from sequence to sequence and from partition to partition
without a task that walks through them.

Only a document's place in its queue needs a shuffle (running sums in cells of
the hash, narrow rows). A source with less than one token a window has no
deficit worth keeping: all of them share one queue, in hashed order. So there
are at most ``window`` queues of their own, whatever the number of sources,
and their sizes are all the driver sees.

Text is tokenised once. It is cut before the last white space ahead of a
visible character and between a letter and a mark, where the pattern of
byte-level tokenizers always cuts; a piece between two cuts is tokenised when
a task meets it for the first time.

Null text is empty: it has the end id only. Null sources are a queue. Repeated
rows and ids are documents of their own, in any order among themselves. An
empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tessera.llm.words import SLICE_BYTES, ragged, slices
from tessera.operators.ranges import split_window
from tessera.session import cut_lineage

WINDOW = 1024
END = 0
# a queue is served this many tokens at a time
LEAST = 32
SEED = 11
# rows of a queue that one task sums up
CELL_ROWS = 2_500
# pieces of text a Python worker remembers the ids of
KNOWN = 1 << 19
# numbers of a schedule that are looked at together
BLOCK = 1 << 21

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3] = True  # first byte of U+00C0 to U+00FF, letters and two signs
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = _VISIBLE & ~_LETTER
_MARK[[*range(0x30, 0x3A), 0xC3]] = False
# one run of letters, which the pattern keeps whole
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# byte-level tokenizers write a byte as a visible character: itself, or the next one from U+0100 on
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_AS_SHOWN = {b: b if b in _SHOWN else 256 + sum(c not in _SHOWN for c in range(b)) for b in range(256)}
_SPACE = chr(_AS_SHOWN[0x20])


class Encoder:
    """Token ids of whole texts, by a byte-level tokenizer (its file's content)."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        # strings of special tokens are ordinary text
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first, self.ids = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]

    def _learn(self, units: list[bytes]) -> None:
        plain, other, ids, tokens_of = [], [], [], self.tokenizer.model.tokenize
        for unit in units:
            if unit[:1] == b" " and unit[1:].isalpha():  # of bytes: A-Z and a-z
                shown = _SPACE + unit[1:].decode()
            elif _PLAIN.fullmatch(unit):
                shown = unit.decode("latin-1").translate(_AS_SHOWN)
            else:
                other.append(unit)
                continue
            plain.append(unit)
            ids.append([t.id for t in tokens_of(shown)])
        ids += [e.ids for e in self.tokenizer.encode_batch([u.decode() for u in other], add_special_tokens=False)]
        self.number.update(zip([*plain, *other], range(len(self.number), len(self.number) + len(units))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = [np.concatenate([*self.first, self.first[-1][-1] + np.cumsum(lengths)])]
        self.ids.append(np.fromiter((i for e in ids for i in e), np.int64, int(lengths.sum())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[:-2] = ((data[:-1] == 0x20) | (data[:-1] == 0x0A)) & _VISIBLE[data[1:]]
            cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
            cut[offsets - 1] = False  # a text's last byte is not ahead of the next text's first
        cut[offsets] = True
        at = np.flatnonzero(cut)
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        )
        coded = units.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) + len(names) > KNOWN:
            self._forget()
        known = self.number.get
        number = np.array([known(u, -1) for u in names], np.int64)
        unknown = np.flatnonzero(number < 0)
        fresh = [names[i] for i in unknown]
        for i in range(0, len(fresh), 5000):
            self._learn(fresh[i : i + 5000])
        number[unknown] = [known(u) for u in fresh]
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        first, ids = self.first[0], self.ids[0]
        number = number[coded.indices.to_numpy()]
        lengths = first[number + 1] - first[number]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids[ragged(first[number], lengths)], np.diff(total[np.searchsorted(at, offsets)])


@lru_cache(maxsize=1)
def _encoder(content: str) -> Encoder:
    """One per Python worker, so that its later tasks know the pieces of its earlier ones."""
    return Encoder(content)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``data``; ``ends`` are in bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def id_type(tokenizer: str, end: int = END) -> str:
    """Two bytes if all ids of the tokenizer fit, else four."""
    ids = _encoder(Path(tokenizer).read_text(encoding="utf-8")).tokenizer.get_vocab_size()
    return "<u2" if max(ids - 1, end) < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer: str, *, end: int = END) -> DataFrame:
    """(doc_id, source, n, ids, row), written once: ids with ``end`` last, little-endian, ``id_type`` each."""
    kept = [docs.schema["doc_id"], docs.schema["source"]]
    schema = StructType([*kept, StructField("n", LongType()), StructField("ids", BinaryType())])
    content = Path(tokenizer).read_text(encoding="utf-8")  # tasks need no file of their own
    kind = id_type(tokenizer, end)

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        encoder = _encoder(content)
        for batch in batches:
            for part in slices(batch, "text", 4 * SLICE_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                out = np.full(len(ids) + len(counts), end, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                n = counts + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array(n, pa.int64()), _binary(out.view(np.uint8), out.itemsize * np.cumsum(n))],
                    names=["doc_id", "source", "n", "ids"],
                )

    rows = docs.select("doc_id", "source", "text").mapInArrow(run, schema)
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))


class Schedule:
    """What deficit round-robin has served of each queue before a round.

    With t the credit per unit of weight, queue q has credit for
    min(size, weight * t) tokens, linear in t between the times at which queues
    run dry; round r begins at the t where all credits sum to r * window.
    """

    def __init__(self, sizes, weights, window: int = WINDOW, least: int = LEAST):
        self.sizes, self.weights = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
        self.window, self.least = window, least
        self.total = int(np.asarray(sizes, np.int64).sum())
        self.rounds = -(-self.total // window)
        self.times = np.concatenate([[0.0], np.unique(self.sizes / self.weights)])
        self.totals = np.array([np.minimum(self.sizes, self.weights * t).sum() for t in self.times])

    def _time(self, rounds: np.ndarray) -> np.ndarray:
        x = rounds * float(self.window)
        i = np.clip(np.searchsorted(self.totals, x, "right") - 1, 0, len(self.times) - 2)
        slope = (self.times[i + 1] - self.times[i]) / np.maximum(self.totals[i + 1] - self.totals[i], 1e-9)
        return np.minimum(self.times[i] + (x - self.totals[i]) * slope, self.times[i + 1])  # never decreases

    def credit(self, rounds: np.ndarray) -> np.ndarray:
        """Credit of every queue before each of the rounds, in tokens."""
        return np.minimum(self.sizes, self.weights * self._time(np.asarray(rounds))[:, None])

    def _whole(self, credit, sizes, rounds) -> np.ndarray:
        done = (credit >= sizes) | (rounds >= self.rounds)
        return np.where(done, sizes, np.floor(credit / self.least) * self.least).astype(np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of every queue in earlier rounds; the credit less this is the queue's deficit."""
        rounds = np.asarray(rounds)
        return self._whole(self.credit(rounds), self.sizes, rounds[:, None])

    def served_of(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """``served`` of one queue per round."""
        sizes = self.sizes[queue]
        return self._whole(np.minimum(sizes, self.weights[queue] * self._time(rounds)), sizes, rounds)

    def round_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The round that serves token ``at`` of its queue: the last one before which at most ``at`` are served."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.rounds, np.int64)
        while (high - low > 1).any():
            middle = (low + high) // 2
            before = self.served_of(queue, middle) <= at
            low, high = np.where(before, middle, low), np.where(before, high, middle)
        return low

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of (document, start in the queue, length, place in the order of all tokens), by document and start."""
        a = self.round_of(queue, first)
        counts = self.round_of(queue, first + n - 1) - a + 1
        ends = np.cumsum(counts)
        step = max(1, BLOCK // len(self.sizes))
        for low in range(0, int(ends[-1]) if len(ends) else 0, step):
            at = np.arange(low, min(low + step, int(ends[-1])))
            doc = np.searchsorted(ends, at, "right")
            q, r = queue[doc], a[doc] + at - (ends[doc] - counts[doc])
            rounds, place = np.unique(r, return_inverse=True)
            now, after = self.served(rounds), self.served(rounds + 1)
            # tokens of earlier rounds, and of this round's earlier queues
            ahead = now.sum(1)[:, None] + np.cumsum(after - now, 1) - (after - now)
            begin, stop = now[place, q], after[place, q]
            start = np.maximum(begin, first[doc])
            length = np.minimum(stop, first[doc] + n[doc]) - start
            ok = length > 0
            yield doc[ok], start[ok], length[ok], (ahead[place, q] + start - begin)[ok]


class Sequences:
    """Sequences of ``window`` tokens; what is left at the end is cut into powers of two, which need no padding."""

    def __init__(self, total: int, window: int = WINDOW):
        self.window, self.full = window, total // window
        rest = total % window
        self.tail = np.cumsum([0] + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])

    def of(self, at: np.ndarray) -> np.ndarray:
        beyond = np.searchsorted(self.tail, at - self.full * self.window, "right") - 1
        return np.where(at < self.full * self.window, at // self.window, self.full + beyond)

    def start(self, sequence: np.ndarray) -> np.ndarray:
        beyond = np.clip(sequence - self.full, 0, len(self.tail) - 1)
        return np.where(sequence < self.full, sequence * self.window, self.full * self.window + self.tail[beyond])


def _queues(coded: DataFrame, weights: Mapping[str | None, float] | None, rest: float, window: int):
    """(source -> queue) table, sizes and weights of all queues; the last queue is shared."""
    sizes = cut_lineage(coded.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total, rows = sizes.agg(F.sum("tokens"), F.sum("rows")).first()
    if weights is None:
        # no more than ``window`` sources can have a token in each window
        own = sizes.where(F.col("tokens") * window >= (total or 0))
    else:
        named = [F.col("source").eqNullSafe(F.lit(s)) for s, w in weights.items() if w > 0]
        own = sizes.where(reduce(lambda a, b: a | b, named, F.lit(False)))
    found = sorted(own.collect(), key=lambda r: (r["source"] is None, r["source"]))
    each = [r["tokens"] for r in found]
    shared = (total or 0) - sum(each)
    shares = each if weights is None else [float(weights[r["source"]]) for r in found]
    if shared:
        each, shares = [*each, shared], [*shares, shared if weights is None else rest]
    codes = coded.sparkSession.createDataFrame(
        [(r["source"], i) for i, r in enumerate(found)],
        StructType([StructField("__source", coded.schema["source"].dataType), StructField("queue", LongType())]),
    )
    return codes, len(found), each, shares, rows or 0


def pack(docs: DataFrame, tokenizer: str, *, weights: Mapping[str | None, float] | None = None, rest: float = 1.0,
         window: int = WINDOW, least: int = LEAST, end: int = END, seed: int = SEED) -> DataFrame:
    """Pieces of documents in sequences: doc_id, source, start, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit numbers. ``weights`` are target
    shares by source (any scale); sources without one share a queue of weight
    ``rest``. Without weights the targets are the corpus's own shares, so that
    no queue runs dry before the end and every sequence holds the same mixture.
    """
    coded = tokenize(docs, tokenizer, end=end)
    codes, shared, sizes, shares, rows = _queues(coded, weights, rest, window)
    if not rows:
        sizes, shares = [1], [1]
    schedule = Schedule(sizes, shares, window, least)
    sequences = Sequences(schedule.total, window)
    bits = max(1, min(40, (rows // CELL_ROWS).bit_length()))
    # ``codes`` has at most ``window`` rows or one per weight given
    queued = (
        coded.select("source", "doc_id", "n", "row", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
        .join(F.broadcast(codes), F.col("source").eqNullSafe(F.col("__source")), "left")
        .select(F.coalesce("queue", F.lit(shared).cast("long")).alias("queue"), "h", "doc_id", "n", "row")
    )
    placed = split_window(
        queued, ["queue"], ["h", "doc_id", "row"], bucket=F.shiftright("h", 64 - bits), sums={"upto": "n"}
    ).select("row", "queue", (F.col("upto") - F.col("n")).alias("first"))
    long, kind = LongType(), id_type(tokenizer, end)
    schema = StructType([
        coded.schema["doc_id"], coded.schema["source"], StructField("start", long), StructField("ids", BinaryType()),
        StructField("doc_tokens", long), StructField("sequence_id", long), StructField("offset", long),
    ])

    def cut(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for part in _by_bytes(batch):
                yield from _cut(part, schedule, sequences, kind)

    return coded.select("doc_id", "source", "n", "ids", "row").join(placed, "row").drop("row").mapInArrow(cut, schema)


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most a slice of ids, or one row."""
    total = np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())]) * 4
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(total, total[at] + 4 * SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _cut(part: pa.RecordBatch, schedule: Schedule, sequences: Sequences, kind: str) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of a batch, cut where a round or a sequence ends."""
    n, first = part.column("n").to_numpy(), part.column("first").to_numpy()
    ids = np.frombuffer(b"".join(v.as_buffer() for v in part.column("ids")), kind).astype("<u4").view(np.uint8)
    at = 0  # pieces come in the order of the documents and tile them
    for doc, start, length, place in schedule.pieces(part.column("queue").to_numpy(), first, n):
        low, high = sequences.of(place), sequences.of(place + length - 1)
        counts = high - low + 1
        each = np.repeat(np.arange(len(doc)), counts)
        sequence = ragged(low, counts)
        begin = np.maximum(place[each], sequences.start(sequence))
        size = np.minimum(place[each] + length[each], sequences.start(sequence + 1)) - begin
        doc = doc[each]
        ends = 4 * np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array(doc)), part.column("source").take(pa.array(doc)),
                pa.array(start[each] + begin - place[each] - first[doc], pa.int64()),
                _binary(ids[at : at + int(ends[-1])], ends), pa.array(n[doc], pa.int64()),
                pa.array(sequence, pa.int64()), pa.array(begin - sequences.start(sequence), pa.int64()),
            ],
            names=["doc_id", "source", "start", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        at += int(ends[-1])


def sequences_of(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids, and segments (offset, doc_id, start) in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    whole = F.aggregate("parts", F.lit(b""), lambda before, p: F.concat(before, p["ids"]))
    return (
        pieces.groupBy("sequence_id").agg(parts.alias("parts"))
        .select(
            "sequence_id", whole.alias("ids"),
            F.transform("parts", lambda p: F.struct(p["offset"], p["doc_id"], p["start"])).alias("segments"),
        )
        .withColumn("length", (F.octet_length("ids") / 4).cast("long"))
    )
