"""Phrase collocations from counting quotient filters.

Words that occur often enough get dense ids. A phrase of m words is packed into
one number: the number of its first m - 1 words, a frequent phrase one level
down, and the id of its last word. The number is permuted one-to-one over its
bits; the high bits name a shard, the next ones are the quotient and the rest
is the remainder, kept whole, so that no two phrases are ever taken for one
another and a phrase can be read back from its place. A ``QuotientFilter`` holds
one shard of one slice of the corpus: runs of remainders by quotient in unary,
remainders in whole bytes, counters in one byte with long ones aside. The
filters of a shard are sorted, and a task merges them into one.

Level m counts only phrases whose two parts of m - 1 words are frequent, as
all frequent phrases' are. A slice learns which of its phrases are frequent from
the tasks that merge the shards: they hand each slice the numbers of its own
phrases. So the text is read once and no table of words or phrases is sent to
all tasks; a hot word or phrase is one counter in each slice's filter.

Slices hold one language and about ``SLICE`` bytes; a longer text is cut where a
phrase cannot reach across. Null texts are empty, a null language is ``und``,
repeated rows count as often as they occur, empty tables give no rows. Columns
beyond text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import _BYTE, _ODD, _ODD_INVERSE, ragged, run_hashes
from tessera.session import cut_lineage, release

LONGEST = 5
LEAST = 100
SLICE = 1 << 21
# words of a slice at most, where there is a place to cut
SLICE_WORDS = 1 << 19
# counters a merging task holds, about
SHARD = 1 << 20
# phrases of a language that are ranked together before the last ranking
SALTS = 64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U8 = np.dtype("<u8")
_U4 = np.dtype("<u4")


# --- permutation and filters -------------------------------------------------

_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def narrow(values: np.ndarray, bits: int) -> bytes:
    """Numbers below 2^bits in as few whole bytes as hold them."""
    return np.ascontiguousarray(values.astype(_U8)).view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def widen(data, bits: int) -> np.ndarray:
    """The inverse of ``narrow``."""
    width = -(-bits // 8)
    out = np.zeros((len(data) // width if width else 0, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(_U8)[:, 0]


def permute(keys: np.ndarray, width: int) -> np.ndarray:
    """A one-to-one map of the numbers below 2^width onto themselves that spreads them evenly."""
    half, mask = np.uint64((width + 1) // 2), _mask(width)
    for factor in _FACTORS:
        keys = keys ^ (keys >> half)
        keys = (keys * np.uint64(factor)) & mask
    return keys ^ (keys >> half)


def restore(keys: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``permute``."""
    half, mask = np.uint64((width + 1) // 2), _mask(width)
    keys = keys ^ (keys >> half)
    for factor in reversed(_FACTORS):
        keys = (keys * np.uint64(pow(factor, -1, 1 << 64))) & mask
        keys = keys ^ (keys >> half)
    return keys


class QuotientFilter:
    """Lossless counters of distinct sorted keys below 2^width, as bytes."""

    @staticmethod
    def encode(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
        quotient_bits = min(width, max(1, len(keys).bit_length()))
        low = np.uint64(width - quotient_bits)
        runs = np.bincount((keys >> low).astype(np.int64), minlength=1 << quotient_bits)
        unary = np.ones(len(keys) + len(runs), np.uint8)
        unary[np.cumsum(runs) + np.arange(len(runs))] = 0
        large = counts >= 255
        head = np.array([len(keys), quotient_bits, width, int(large.sum())], _U4)
        return b"".join([
            head.tobytes(), np.packbits(unary).tobytes(), narrow(keys & _mask(int(low)), int(low)),
            np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype(_U8).tobytes(),
        ])

    @staticmethod
    def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, quotient_bits, width, large = (int(x) for x in np.frombuffer(data, _U4, 4))
        at, total = 16, n + (1 << quotient_bits)
        unary = np.unpackbits(np.frombuffer(data, np.uint8, -(-total // 8), at))[:total]
        at += -(-total // 8)
        upto = np.flatnonzero(unary == 0) - np.arange(1 << quotient_bits)
        quotient = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), np.diff(upto, prepend=0))
        wide = -(-(width - quotient_bits) // 8)
        remainder = np.zeros((n, 8), np.uint8)
        remainder[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
        at += n * wide
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, _U8, large, at + n)
        return (quotient << np.uint64(width - quotient_bits)) | remainder.view(_U8)[:, 0], counts

    @staticmethod
    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of sorted filters, sorted."""
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts[order], first)


# --- words -------------------------------------------------------------------


def _sections(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(tokens, words, counts) of runs of pieces: numbers of ``words`` from 1, with 0 between pieces."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    data, offsets = _LOWER[data], offsets - offsets[0]
    mark = _MARK[data]
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~(_BLANK[data] | mark)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    if not len(starts):
        return
    # marks and text ends so far; words of one piece have the same number of them
    piece = (np.cumsum(mark) + np.cumsum(edge[:-1]))[starts]
    new = np.concatenate([[True], piece[1:] != piece[:-1]])
    hashes = run_hashes(_BYTE[data], _ODD, _ODD_INVERSE, starts, ends)
    cuts = np.append(np.flatnonzero(new), len(starts))
    low = 0
    while low < len(starts):
        high = int(cuts[np.searchsorted(cuts, low + SLICE_WORDS, "right") - 1])
        if high <= low:  # a piece longer than a slice
            high = int(cuts[np.searchsorted(cuts, low, "right")])
        _, first, number, counts = np.unique(hashes[low:high], return_index=True, return_inverse=True, return_counts=True)
        tokens = np.zeros(high - low + int(new[low:high].sum()), np.int64)
        tokens[np.arange(high - low) + np.cumsum(new[low:high])] = number + 1
        a, length = starts[low:high][first], (ends - starts)[low:high][first]
        words = pa.LargeStringArray.from_buffers(
            len(a), pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64)),
            pa.py_buffer(np.ascontiguousarray(data[ragged(a, length)])),
        )
        yield tokens, words.cast(pa.string()), counts
        low = high


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def slices_of(docs: DataFrame) -> DataFrame:
    """(slice, lang, n, tokens, words, counts), written once; tokens are little-endian 2 or 4 bytes each."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= SLICE:
                yield from table(held)
                held, size = [], 0
        if held:
            yield from table(held)

    def table(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        for lang in pc.unique(rows.column("lang")).to_pylist():
            texts = rows.filter(pc.equal(rows.column("lang"), lang)).column("text").combine_chunks()
            for tokens, words, counts in _sections(texts):
                kind = "<u2" if len(words) < 1 << 16 else "<u4"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([int(counts.sum())]), pa.array([tokens.astype(kind).tobytes()], pa.binary()),
                     _listed(words), _listed(pa.array(counts))],
                    names=["lang", "n", "tokens", "words", "counts"],
                )

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "lang string, n long, tokens binary, words array<string>, counts array<bigint>"
    )
    return cut_lineage(rows.withColumn("slice", F.monotonically_increasing_id()))


# --- frequent words ----------------------------------------------------------


def _word_shards(slices: DataFrame, shard_bits: int) -> DataFrame:
    """The words of every slice by shard: (shard, slice, lang, places in the dictionary, words, counts)."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for r in range(len(batch)):
                words = batch.column("words")[r].values.cast(pa.large_string())
                counts = batch.column("counts")[r].values
                at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
                data = np.frombuffer(words.buffers()[2], np.uint8)
                hashes = run_hashes(_BYTE[data[at[0] : at[-1]]], _ODD, _ODD_INVERSE, at[:-1] - at[0], at[1:] - at[0])
                shard = (hashes >> np.uint64(64 - shard_bits)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                shards, first = np.unique(shard[order], return_index=True)
                ends, lists = np.append(first, len(order)), pa.array(np.append(first, len(order)), pa.int32())
                picked = pa.array(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards), pa.array([batch.column("slice")[r].as_py()] * len(shards), pa.int64()),
                     pa.array([batch.column("lang")[r].as_py()] * len(shards)),
                     pa.array([order[x:y].astype(_U4).tobytes() for x, y in zip(ends, ends[1:])], pa.binary()),
                     pa.ListArray.from_arrays(lists, words.take(picked).cast(pa.string())),
                     pa.ListArray.from_arrays(lists, counts.take(picked))],
                    names=["shard", "slice", "lang", "places", "words", "counts"],
                )

    return slices.select("slice", "lang", "words", "counts").mapInArrow(
        run, "shard long, slice long, lang string, places binary, words array<string>, counts array<bigint>"
    )


def _merged_words(shards: DataFrame, least: int) -> DataFrame:
    """Per shard and language the frequent words with counts (slice null); per slice the places and ranks of its own."""

    def merge(rows: pa.Table) -> pa.Table:
        shard, size, found = rows.column("shard")[0].as_py(), 0, []
        for lang in pc.unique(rows.column("lang")).to_pylist():
            part = rows.filter(pc.equal(rows.column("lang"), lang)).combine_chunks()
            lists = part.column("words").combine_chunks()
            coded = lists.flatten().dictionary_encode()
            number = coded.indices.to_numpy()
            counts = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(counts, number, part.column("counts").combine_chunks().flatten().to_numpy())
            often = np.flatnonzero(counts >= least)
            if not len(often):
                continue
            rank = np.full(len(counts), -1)
            rank[often] = size + np.arange(len(often))
            found.append((None, lang, size, coded.dictionary.take(pa.array(often)).to_pylist(), counts[often].astype(_U8).tobytes(), None))
            size += len(often)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            for i, (name, places) in enumerate(zip(part.column("slice").to_pylist(), part.column("places").to_pylist())):
                own = rank[number[ends[i] : ends[i + 1]]]
                hit = own >= 0
                if hit.any():
                    found.append((name, None, None, None, own[hit].astype(_U4).tobytes(), np.frombuffer(places, _U4)[hit].tobytes()))
        columns = list(zip(*found)) if found else [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        names = ["slice", "lang", "first", "words", "values", "places"]
        return pa.table(
            [pa.array([shard] * len(found), pa.int64()), *[pa.array(v, k) for v, k in zip(columns, kinds)]], ["shard", *names]
        )

    return cut_lineage(shards.groupBy("shard").applyInArrow(
        merge, "shard long, slice long, lang string, first long, words array<string>, values binary, places binary"
    ))


def _vocabulary(merged: DataFrame, most: int) -> DataFrame:
    """(number, lang, word, a) of the frequent words; numbers begin with 1."""

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                words = batch.column("words")[r].values
                start = batch.column("shard")[r].as_py() * most + batch.column("first")[r].as_py() + 1
                counts = np.frombuffer(batch.column("values")[r].as_buffer(), _U8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(start + np.arange(len(words))), pa.array([batch.column("lang")[r].as_py()] * len(words)), words,
                     pa.array(counts.astype(np.int64))],
                    names=["number", "lang", "word", "a"],
                )

    return cut_lineage(
        merged.where(F.col("slice").isNull()).select("shard", "lang", "first", "words", "values")
        .mapInArrow(run, "number long, lang string, word string, a long")
    )


# --- levels ------------------------------------------------------------------

# a level's phrases in a slice: (slice, places in the slice, packed phrases)
Entries = Iterator[tuple[int, np.ndarray, np.ndarray]]


def _pairs(bits: int, most: int) -> Callable[[pa.RecordBatch], Entries]:
    """Pairs of frequent words from (slice, tokens, size, ids: list of (shard, places in the dictionary, ranks))."""

    def read(batch: pa.RecordBatch) -> Entries:
        for r in range(len(batch)):
            size = batch.column("size")[r].as_py()
            id_of = np.zeros(size + 1, np.uint64)
            for f in batch.column("ids")[r].as_py():
                ranks = np.frombuffer(f["values"], _U4).astype(np.uint64)
                id_of[np.frombuffer(f["places"], _U4) + 1] = ranks + np.uint64(f["shard"] * most + 1)
            tokens = np.frombuffer(batch.column("tokens")[r].as_buffer(), "<u2" if size < 1 << 16 else "<u4")
            ids = id_of[tokens]
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            yield batch.column("slice")[r].as_py(), at, (ids[at] << np.uint64(bits)) | ids[at + 1]

    return read


def _kept(width: int) -> Callable[[pa.RecordBatch], Entries]:
    """A written level: (slice, at, key) as bytes."""

    def read(batch: pa.RecordBatch) -> Entries:
        for r in range(len(batch)):
            at, key = batch.column("at")[r].as_buffer(), batch.column("key")[r].as_buffer()
            yield batch.column("slice")[r].as_py(), np.frombuffer(at, _U4), widen(key, width)

    return read


def _filters(rows: DataFrame, read, width: int, shard_bits: int) -> DataFrame:
    """One filter per slice and shard that has phrases of it: (shard, slice, filter)."""
    low = width - shard_bits

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for number, _, keys in read(batch):
                keys, counts = np.unique(permute(keys, width), return_counts=True)
                shards, first = np.unique(keys >> np.uint64(low), return_index=True)
                ends = np.append(first, len(keys))
                filters = [
                    QuotientFilter.encode(keys[a:b] & _mask(low), counts[a:b], low) for a, b in zip(ends, ends[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards.astype(np.int64)), pa.array([number] * len(shards), pa.int64()), pa.array(filters, pa.binary())],
                    names=["shard", "slice", "filter"],
                )

    return rows.mapInArrow(run, "shard long, slice long, filter binary")


def _merged(filters: DataFrame, least: int, low: int) -> DataFrame:
    """Per shard the frequent keys with counts (slice null), and per slice those of them that it has, with their ranks."""

    def merge(rows: pa.Table) -> pa.Table:
        parts = [QuotientFilter.decode(v.as_buffer()) for v in rows.column("filter").combine_chunks()]
        keys, counts = QuotientFilter.merge(parts)
        often = counts >= least
        keys, counts = keys[often], counts[often]
        shard, found = rows.column("shard")[0].as_py(), []
        if len(keys):
            found.append((None, len(keys), narrow(keys, low), counts.astype(_U8).tobytes()))
            for number, (own, _) in zip(rows.column("slice").to_pylist(), parts):
                rank = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[rank] == own
                if hit.any():
                    found.append((number, int(hit.sum()), narrow(own[hit], low), rank[hit].astype(_U4).tobytes()))
        slices, sizes, names, values = zip(*found) if found else ((), (), (), ())
        return pa.table({
            "shard": pa.array([shard] * len(found), pa.int64()), "slice": pa.array(slices, pa.int64()),
            "size": pa.array(sizes, pa.int64()), "keys": pa.array(names, pa.binary()), "values": pa.array(values, pa.binary()),
        })

    return cut_lineage(
        filters.groupBy("shard").applyInArrow(merge, "shard long, slice long, size long, keys binary, values binary")
    )


def _next_level(rows: DataFrame, read, merged: DataFrame, width: int, shard_bits: int, most: int, bits: int) -> DataFrame:
    """Phrases of one more word whose both parts are frequent: (slice, at, key), written once."""
    low, longer_width = width - shard_bits, (most << shard_bits).bit_length() + bits
    own = merged.where(F.col("slice").isNotNull()).groupBy("slice").agg(
        F.collect_list(F.struct("shard", "keys", "values")).alias("own")
    )

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for r, (number, at, keys) in enumerate(read(batch)):
                found = batch.column("own")[r].as_py()
                names = np.concatenate([(np.uint64(f["shard"]) << np.uint64(low)) | widen(f["keys"], low) for f in found])
                ranks = np.concatenate([np.uint64(f["shard"] * most) + np.frombuffer(f["values"], _U4) for f in found])
                order = np.argsort(names)
                names, ranks = names[order], ranks[order]
                place = permute(keys, width)
                i = np.minimum(np.searchsorted(names, place), len(names) - 1)
                hit = names[i] == place
                at, keys, numbers = at[hit], keys[hit], ranks[i[hit]]
                # the phrase that begins one word later ends in the new word
                both = np.flatnonzero(at[1:] == at[:-1] + 1)
                if len(both):
                    longer = (numbers[both] << np.uint64(bits)) | (keys[both + 1] & _mask(bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), pa.array([at[both].astype(_U4).tobytes()], pa.binary()),
                         pa.array([narrow(longer, longer_width)], pa.binary())],
                        names=["slice", "at", "key"],
                    )

    return cut_lineage(rows.join(own, "slice").mapInArrow(run, "slice long, at binary, key binary"))


def _phrases(merged: DataFrame, width: int, shard_bits: int, most: int, bits: int) -> DataFrame:
    """(number, first, last, a) of the frequent phrases of a level."""
    low = width - shard_bits

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                shard = batch.column("shard")[r].as_py()
                own = widen(batch.column("keys")[r].as_buffer(), low)
                keys = restore((np.uint64(shard) << np.uint64(low)) | own, width)
                counts = np.frombuffer(batch.column("values")[r].as_buffer(), _U8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((shard * most + np.arange(len(keys))).astype(np.int64)),
                     pa.array((keys >> np.uint64(bits)).astype(np.int64)),
                     pa.array((keys & _mask(bits)).astype(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["number", "first", "last", "a"],
                )

    return merged.where(F.col("slice").isNull()).mapInArrow(run, "number long, first long, last long, a long")


def frequent_phrases(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a) of all phrases of up to ``longest`` words found ``least`` times, and (lang, n) of all words."""
    slices = slices_of(docs)
    totals = cut_lineage(slices.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.size("words")).alias("__entries")))
    size, entries = totals.agg(F.sum("n"), F.sum("__entries")).first()
    size, entries = size or 0, entries or 0
    word_bits = max(4, (entries // SHARD).bit_length())
    counted = _merged_words(_word_shards(slices, word_bits), least)
    most = counted.where(F.col("slice").isNull()).agg(F.max(F.col("first") + F.size("words"))).first()[0] or 1
    ids = _vocabulary(counted, most)
    bits = (most << word_bits).bit_length()
    shard_bits = max(4, (size // SHARD).bit_length())
    own = counted.where(F.col("slice").isNotNull()).groupBy("slice").agg(
        F.collect_list(F.struct("shard", "places", "values")).alias("ids")
    )
    rows = slices.select("slice", "tokens", F.size("words").alias("size")).join(own, "slice")
    read, known = _pairs(bits, most), ids.select("number", "lang", F.array("word").alias("words"), "a")
    levels, numbers, done = [known], bits, [slices, counted]
    for length in range(2, longest + 1):
        width = max(numbers + bits, shard_bits + 1)
        if width > 64:
            raise ValueError("phrases of this corpus do not fit into 64 bits")
        merged = _merged(_filters(rows, read, width, shard_bits), least, width - shard_bits)
        most = merged.where(F.col("slice").isNull()).agg(F.max("size")).first()[0]
        if not most:
            break
        known = cut_lineage(
            _phrases(merged, width, shard_bits, most, bits)
            .join(known.select(F.col("number").alias("first"), "lang", F.col("words").alias("__w")), "first")
            .join(ids.select(F.col("number").alias("last"), F.col("word").alias("__last")), "last")
            .select("number", "lang", F.concat("__w", F.array("__last")).alias("words"), "a")
        )
        levels.append(known)
        if length < longest:
            rows = _next_level(rows, read, merged, width, shard_bits, most, bits)
            release(*done, merged)
            numbers, done = (most << shard_bits).bit_length(), [rows]
            read = _kept(numbers + bits)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a"), totals


def collocations(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, share: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is floor(1000 * a * n / (l * r)) at its weakest cut. A phrase inside a
    longer frequent one that has ``share`` percent of its occurrences is left out. Products
    are taken as decimals of 38 digits, which hold them for up to 10^15 words a language.
    """
    found, totals = frequent_phrases(docs, longest=longest, least=least)
    found = cut_lineage(found)
    wide = found.where(F.size("words") > 1)
    # what lies inside a longer phrase lies inside one that is longer by a word and found no less often
    inner = F.explode(F.array(
        F.array_join(F.expr("slice(words, 1, size(words) - 1)"), " "), F.array_join(F.expr("slice(words, 2, size(words) - 1)"), " ")
    ))
    longer = wide.where(F.size("words") > 2).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("__longer")
    )
    left = wide.join(longer, ["lang", "phrase"], "left").where(
        F.col("__longer").isNull() | (F.col("__longer") * 100 < F.col("a") * share)
    )
    cuts = left.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.expr("slice(words, 1, k)"), " ").alias("__first"),
        F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ").alias("__rest"),
    )
    counts = found.select("lang", "phrase", "a")
    scored = (
        cuts.join(counts.select("lang", F.col("phrase").alias("__first"), F.col("a").alias("l")), ["lang", "__first"])
        .join(counts.select("lang", F.col("phrase").alias("__rest"), F.col("a").alias("r")), ["lang", "__rest"])
        .join(totals, "lang")
    )
    above = F.col("a").cast("decimal(18,0)") * F.col("n").cast("decimal(16,0)") * F.lit(1000).cast("decimal(4,0)")
    below = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    scored = scored.select("lang", "phrase", "a", "k", "l", "r", "n", above.alias("__above"), below.alias("__below")).selectExpr(
        "lang", "phrase", "a", "k", "l", "r", "n", "__above div __below as score"
    )
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("__cut")).select(
        "lang", "phrase", "a", "n", "__cut.score", "__cut.l", "__cut.r"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    ranked = weakest.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    last = Window.partitionBy("lang").orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
