"""Benchmark decontamination: edit-distance search for benchmark items in whole texts.

Texts are lower-cased (A-Z), ASCII punctuation and white space become single
spaces. Item-sized windows are cut at word starts: for a long item, windows of
the largest of ``WINDOWS`` characters at all its words, for a shorter item of
the size that still leaves a window for each of ``STRIDE`` word offsets; a text
is cut at every ``STRIDE``-th word. So a copied passage has windows that begin
where one of the item's begins.

A window is embedded by the CGK random walk: at step j the character under the
pointer is written out and the pointer moves on by a random bit that depends
on j and the character. Few edits change few places of the output, so edit
distance becomes Hamming distance, and ``SAMPLED`` places of the output make a
locality-sensitive key. ``WALKS`` walks of ``SAMPLES`` samples each repeat the
test; with a share h of changed places one key agrees with chance
(1 - h)^SAMPLED, and a passage has a window every ``STRIDE`` words, each with
all its keys (``expected_recall``). The walk of a small window is the beginning
of the walk of a large one, so a text is walked once for all sizes.

Items of fewer than ``PIECED`` characters have too few windows for the target
recall and get further keys: where k edits are allowed, an item is cut into
k + 1 pieces; one of them is left unchanged, so its first (at most 8) characters
stand in the text, and texts are looked up at every character. This misses
nothing. An item too short for any edit must stand in the text as whole words;
it is looked up at every word.

A key that agrees says where the item would begin in the text. Each pair of
item and place (of ``SPAN`` characters) is verified by exact edit distance: the
item must lie there with at most ``TOLERANCE`` of its length in edits. All pairs
of an Arrow batch are computed at once, a column of the text at a time.

Keys of the items set two bits each in one of two bitmaps (walks, others) of 256
to 512 bits per key, 2^``BITMAP_MOST`` bits at most, which every task holds;
windows that miss it are dropped in place, others are joined to the item keys
exactly. No other table is broadcast, and only texts with hits are shuffled, in
pieces around the hits.

Null or empty texts and items match nothing; items that are empty after
normalising are left out. Rows with equal or null ids are judged one by one.
Items with equal texts are all reported. Other columns are unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix, signed, slices
from tessera.session import cut_lineage

TOLERANCE = 0.1
WINDOWS = (48, 24, 12)
STEPS_PER_CHARACTER = 1.5
STRIDE = 2
# items of fewer characters are also found by unchanged pieces
PIECED = 130
GRAM = 8
WALKS = 4
SAMPLES = 2
SAMPLED = 16
# characters of a text in which an item may begin that are verified together
SPAN = 16
BITMAP_LEAST, BITMAP_MOST = 16, 27
SEED = 11
_CHUNK = 8192
# below so many pairs for each 64 characters of the item, pairs are computed one by one
FEW = 24
_PIECE_ODD = 0x9E3779B97F4A7C15

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 32


def expected_recall(changed: float, windows: int) -> float:
    """Chance that one of ``windows`` windows with a share ``changed`` of changed places gives a hit."""
    return 1 - (1 - (1 - changed) ** SAMPLED) ** (windows * WALKS * SAMPLES)


GAP = int(max(WINDOWS) * STEPS_PER_CHARACTER) + 1


class Folded:
    """Normalised texts of a slice: text ``r`` is data[begin[r]:end[r]], zeros follow it; and its word starts."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        data = _FOLD[data[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        space = np.append(data == 32, True)
        before = np.roll(space, 1)
        before[offsets] = True
        keep = ~(space & before)[:-1]
        bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
        shift = np.arange(len(texts)) * GAP
        self.begin, self.end = bounds[:-1] + shift, bounds[1:] + shift
        self.data = np.zeros(bounds[-1] + (len(texts) + 1) * GAP, np.uint8)
        self.data[np.arange(bounds[-1]) + np.repeat(shift, np.diff(bounds))] = data[keep]
        letter = (self.data != 32) & (self.data != 0)
        self.starts = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
        self.first = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.place = np.arange(len(self.starts)) - self.first[self.row]
        self.left = self.end[self.row] - self.starts

    def texts(self) -> list[bytes]:
        return [self.data[a:b].tobytes().rstrip() for a, b in zip(self.begin, self.end)]


def _places(size: int) -> list[list[np.ndarray]]:
    """Sampled places of a window of ``size`` characters, for each walk and sample."""
    steps, out = int(size * STEPS_PER_CHARACTER), []
    for walk in range(WALKS):
        draw = np.random.default_rng([SEED, walk, size])
        out.append([np.sort(draw.choice(steps, min(SAMPLED, steps), replace=False)) for _ in range(SAMPLES)])
    return out


def window_keys(data: np.ndarray, starts: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Keys of the windows that begin at ``starts``, per size: one row per window, WALKS * SAMPLES columns.

    A walk that leaves its text reads the zeros after it.
    """
    out = {size: np.zeros((len(starts), WALKS * SAMPLES), np.uint64) for size in sizes}
    odd, one = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
    places = {size: _places(size) for size in sizes}
    for walk in range(WALKS):
        draw = np.random.default_rng([SEED, walk])
        bits = draw.integers(0, 2, (int(max(WINDOWS) * STEPS_PER_CHARACTER), 256), dtype=np.int64)
        read: dict[int, list[tuple[int, int]]] = {}
        for size in sizes:
            for s, at in enumerate(places[size][walk]):
                for step in at.tolist():
                    read.setdefault(step, []).append((size, s))
        for a in range(0, len(starts), _CHUNK):
            at = starts[a : a + _CHUNK].copy()
            keys = {(size, s): np.zeros(len(at), np.uint64) for size in sizes for s in range(SAMPLES)}
            for step in range(max(read, default=-1) + 1):
                here = data.take(at)
                if step in read:
                    value = here + one
                    for key in map(keys.get, read[step]):
                        key *= odd
                        key += value
                at += bits[step].take(here)
            for (size, s), key in keys.items():
                out[size][a : a + _CHUNK, walk * SAMPLES + s] = mix(mix(key, size), walk * SAMPLES + s)
    return out


def _bits_of(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in a bitmap of 2^width bits."""
    return (keys >> np.uint64(64 - width)).astype(np.int64), _second_bit(keys, width)


def _second_bit(keys: np.ndarray, width: int) -> np.ndarray:
    return ((keys >> np.uint64(64 - 2 * width)) & np.uint64((1 << width) - 1)).astype(np.int64)


def item_windows(folded: Folded) -> list[tuple[int, np.ndarray]]:
    """(window size, indices of word starts) for the items of a slice."""
    out = []
    words = np.diff(folded.first)[folded.row]
    # the largest size that leaves a window at each of the first STRIDE words (or at all words of a short item)
    nth = np.minimum(STRIDE, words) - 1
    room = folded.left[folded.first[folded.row] + nth] if len(folded.row) else folded.left
    chosen = np.full(len(room), min(WINDOWS))
    for size in sorted(WINDOWS):
        chosen[room >= size] = size
    for size in WINDOWS:
        use = (chosen == size) & ((folded.left >= size) | (folded.place < STRIDE))
        if use.any():
            out.append((size, np.flatnonzero(use)))
    return out


def _grams(data: np.ndarray) -> np.ndarray:
    """The GRAM characters from each place on as one number; nothing follows the last."""
    padded = np.append(data, np.zeros(GRAM, np.uint8))
    return np.ndarray(len(data), "<u8", padded, strides=(1,)).astype(np.uint64)


def gram_keys(grams: np.ndarray, size: int, kind: str) -> np.ndarray:
    """Keys of the first ``size`` (at most GRAM) characters of ``grams``; one-to-one for a size and kind."""
    size, salt = min(size, GRAM), size * 2 + (kind == "piece")
    masked = grams & np.uint64((1 << 8 * size) - 1)
    # a product's high bits depend on all characters
    return masked * np.uint64(_PIECE_ODD) + np.uint64(salt * 0xA0761D6478BD642F & (1 << 64) - 1)


def allowed(tolerance: float, length):
    return np.floor(tolerance * np.asarray(length)).astype(np.int64)


def short_keys(item: bytes, tolerance: float) -> list[tuple[int, int, int, str]]:
    """(key, where its characters begin, size, kind) of an item of fewer than PIECED characters."""
    m, edits = len(item), int(allowed(tolerance, len(item)))
    kind = "piece" if edits else "words"
    size = min(GRAM, m // (edits + 1)) if edits else m
    begins = [j * m // (edits + 1) for j in range(edits + 1)]
    grams = np.array([int.from_bytes(item[b : b + GRAM], "little") for b in begins], np.uint64)
    return [(int(k), b, size, kind) for k, b in zip(signed(gram_keys(grams, size, kind)), begins)]


def _emit_items(tolerance: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                folded = Folded(part.column("text"))
                texts = folded.texts()
                made = []
                for size, index in item_windows(folded):
                    keys = window_keys(folded.data, folded.starts[index], [size])[size]
                    rows = folded.row[index]
                    wide = [np.repeat(x, keys.shape[1]) for x in (rows, folded.starts[index] - folded.begin[rows])]
                    made.append((wide[0], signed(keys.ravel()), wide[1], [size] * keys.size, ["walk"] * keys.size))
                short = [(r, *k) for r, t in enumerate(texts) if 0 < len(t) < PIECED for k in short_keys(t, tolerance)]
                made.append(tuple(zip(*short)) if short else ([], [], [], [], []))
                for rows, keys, begin, size, kind in made:
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("item_id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()),
                            pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(kind, pa.string()),
                            pa.array([len(texts[r]) for r in rows], pa.int64()),
                        ],
                        ["item_id", "key", "begin", "size", "kind", "item_bytes"],
                    )

    return run


def _short_hits(
    folded: Folded, bitmap: np.ndarray, width: int, sizes: list[int], kind: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places in the data and keys of the places where a short item may have a piece or begin."""
    at = None if kind == "piece" else folded.starts
    grams = _grams(folded.data)
    places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sizes:
        use = at
        if kind == "words":
            use = at[at + size < len(folded.data)]
            use = use[np.isin(folded.data[use + size], (0, 32))]
        key = gram_keys(grams if use is None else grams[use], size, kind)
        near = np.flatnonzero(bitmap.take((key >> np.uint64(64 - width)).astype(np.int64)))
        near = near[bitmap[_second_bit(key[near], width)]]
        place = near if use is None else use[near]
        inside = folded.data[place] != 0
        places.append(place[inside])
        keys.append(key[near][inside])
    start = np.concatenate(places)
    return np.searchsorted(folded.begin, start, side="right") - 1, start, np.concatenate(keys)


def _find(walks: np.ndarray, others: np.ndarray, sizes: dict[str, list[int]], reach: int, near: int):
    """Pieces of texts around windows that pass the bitmaps, with the keys that pass and where."""

    def run(batches):
        (walked, width), short = _unpacked(walks), _unpacked(others)
        for batch in batches:
            for part in slices(batch, "text"):
                folded = Folded(part.column("text"))
                for kind in sorted({"piece", "words"} & sizes.keys()):
                    row, start, key = _short_hits(folded, *short, sizes[kind], kind)
                    if len(row):
                        yield _pieces(part, folded, row, start, key, near, kind)
                index = np.flatnonzero((folded.place % STRIDE == 0) & (folded.left >= min(WINDOWS)))
                places, keys = [], []
                for found in window_keys(folded.data, folded.starts[index], sizes.get("walk", [])).values():
                    one, two = _bits_of(found, width)
                    hit, column = np.nonzero(walked[one] & walked[two])
                    places.append(index[hit])
                    keys.append(found[hit, column])
                at = np.concatenate(places) if places else []
                if len(at):
                    yield _pieces(part, folded, folded.row[at], folded.starts[at], np.concatenate(keys), reach, "walk")

    return run


def _pieces(
    part: pa.RecordBatch, folded: Folded, row: np.ndarray, at: np.ndarray, key: np.ndarray, reach: int, kind: str
) -> pa.RecordBatch:
    """Stretches of ``reach`` around the places, between marks (zeros) at both ends."""
    order = np.argsort(at, kind="stable")
    row, start, key = row[order], at[order], key[order]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] - start[:-1] > reach)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    rows = row[first]
    begin = np.maximum(start[first] - reach, folded.begin[rows])
    end = np.minimum(start[last] + reach, folded.end[rows])
    pieces = [b"\0" + folded.data[b:e].tobytes() + b"\0" for b, e in zip(begin.tolist(), end.tolist())]
    offsets = pa.array(np.append(first, len(start)).astype(np.int32))
    places = (start - np.repeat(begin, last - first + 1) + 1).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").take(pa.array(rows)), part.column("row").take(pa.array(rows)), pa.array(pieces, pa.binary()),
            pa.ListArray.from_arrays(offsets, pa.array(signed(key))), pa.ListArray.from_arrays(offsets, pa.array(places)),
        ],
        ["doc_id", "row", "piece", "keys", "places"],
    )


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each value begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def _matrix(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """data[begin:begin + length] of each row below one another, filled up with zeros."""
    out = np.zeros((len(begin), int(length.max(initial=0))), np.uint8)
    inside = np.arange(out.shape[1]) < length[:, None]
    row, column = np.nonzero(inside)
    out[inside] = data[begin[row] + column]
    return out


def infix_distances(items: pa.Array, texts: pa.Array) -> np.ndarray:
    """For each pair the least number of edits that turn the item into some run of the text.

    Columns of the edit table are kept as bits (vertical differences, 64 rows
    to a word) and advance by one character of every pair's text at a time.
    Zeros, which no item holds, fill up shorter texts and lower no distance.
    """
    coded = items.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    item_data, item_at = _bytes_of(coded.dictionary)
    text_data, text_at = _bytes_of(texts)
    item_length, text_length = np.diff(item_at), np.diff(text_at)
    words = (item_length[code] + 63) // 64
    out = item_length[code].copy()
    order = np.lexsort((text_length, words))
    order = order[(words[order] > 0) & (text_length[order] > 0)]
    cuts = np.flatnonzero(np.diff(words[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        count = int(words[same[0]])
        step = max(_CHUNK // count, 16)
        for a in range(0, len(same), step):
            pick = same[a : a + step]
            if len(pick) < FEW * count:
                out[pick] = [infix_distance(items[i].as_py(), texts[i].as_py()) for i in pick.tolist()]
                continue
            used, local = np.unique(code[pick], return_inverse=True)
            letters = _matrix(item_data, item_at[used], item_length[used])
            texts_of = _matrix(text_data, text_at[pick], text_length[pick])
            out[pick] = _columns(letters, item_length[used], local, texts_of, count)
    return out


def infix_distance(item: bytes, text: bytes) -> int:
    """The same for one pair, with all rows of a column in one number."""
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << i)
    top, full = 1 << (len(item) - 1), (1 << len(item)) - 1
    up, down, score = full, 0, len(item)
    best = score
    for c in text:
        equal = where.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = (down | ~(across | up)) & full, up & across
        score += bool(plus & top) - bool(minus & top)
        best = min(best, score)
        vertical = equal | down
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
    return best


def _columns(letters: np.ndarray, lengths: np.ndarray, item: np.ndarray, texts: np.ndarray, count: int) -> np.ndarray:
    """Least infix distances of items (rows of ``letters``) numbered ``item`` in the rows of ``texts``."""
    one = np.uint64(1)
    where = np.zeros((count, len(letters) * 256), np.uint64)
    for w in range(count):
        for i in range(w * 64, min(w * 64 + 64, letters.shape[1])):
            rows = np.flatnonzero(lengths > i)
            where[w, rows * 256 + letters[rows, i]] |= one << np.uint64(i - w * 64)
    top = ((lengths[item] - 1) % 64).astype(np.uint64)
    up = [np.full(len(item), ~np.uint64(0)) for _ in range(count)]
    down = [np.zeros(len(item), np.uint64) for _ in range(count)]
    score = lengths[item].astype(np.int64)
    best = score.copy()
    base = item.astype(np.int64) * 256
    for column in np.ascontiguousarray(texts.T):
        at = base + column
        rise = fall = None
        for w in range(count):
            equal = where[w].take(at)
            vertical = equal | down[w]
            if fall is not None:
                equal |= fall
            across = (((equal & up[w]) + up[w]) ^ up[w]) | equal
            plus = down[w] | ~(across | up[w])
            minus = up[w] & across
            if w == count - 1:
                score += ((plus >> top) & one).view(np.int64)
                score -= ((minus >> top) & one).view(np.int64)
            next_rise, next_fall = plus >> np.uint64(63), minus >> np.uint64(63)
            plus <<= one
            minus <<= one
            if rise is not None:
                plus |= rise
                minus |= fall
            up[w] = minus | ~(vertical | plus)
            down[w] = plus & vertical
            rise, fall = next_rise, next_fall
        np.minimum(best, score, out=best)
    return best


def _verify(tolerance: float):
    def run(batches):
        for batch in batches:
            length = batch.column("item_bytes").to_numpy()
            edits = allowed(tolerance, length)
            distance = infix_distances(batch.column("item"), batch.column("window"))
            # an item too short for an edit stands as whole words
            for i in np.flatnonzero((length < PIECED) & (edits == 0) & (distance == 0)):
                window = batch.column("window")[i].as_py().replace(b"\0", b" ")
                if b" " + batch.column("item")[i].as_py() + b" " not in window:
                    distance[i] = length[i]
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("item_id"), pa.array(distance), batch.column("item_bytes")],
                ["doc_id", "row", "item_id", "distance", "item_bytes"],
            )
            yield out.filter(pa.array(distance <= edits))

    return run


def _fold_items(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            folded = Folded(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(folded.texts(), pa.binary())], ["item_id", "item"])


def item_bitmap(keys: DataFrame) -> np.ndarray:
    """The packed bits of the keys of items; 2^BITMAP_MOST at most reach the driver, in numbers of 64."""
    width = min(max((256 * keys.count()).bit_length(), BITMAP_LEAST), BITMAP_MOST)
    one = F.shiftrightunsigned("key", 64 - width)
    two = F.shiftrightunsigned("key", 64 - 2 * width).bitwiseAND(F.lit((1 << width) - 1))
    words = (
        keys.select(F.explode(F.array(one, two)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .toArrow()
    )
    out = np.zeros((1 << width) // 64, np.uint64)
    if words.num_rows:
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _unpacked(bitmap: np.ndarray) -> tuple[np.ndarray, int]:
    """A bitmap as one truth value per bit, and the binary digits of its length."""
    out = np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)
    return out, len(out).bit_length() - 1


def find_leaks(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, row, item_id, distance, item_bytes) of each item found in a row of ``docs``.

    ``row`` is a hash of id and text that names the row also where ids are null or repeated.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    folded = cut_lineage(
        items.select("item_id", "text").mapInArrow(_fold_items, f"item_id {item_kind}, item binary").where("length(item) > 0")
    )
    keys = cut_lineage(
        items.select("item_id", "text").mapInArrow(
            _emit_items(tolerance), f"item_id {item_kind}, key long, begin long, size long, kind string, item_bytes long"
        ).distinct()
    )
    longest = folded.agg(F.max(F.length("item"))).first()[0] or 0
    sizes: dict[str, list[int]] = {}
    for kind_of, size in sorted(tuple(r) for r in keys.select("kind", "size").distinct().collect()):
        sizes.setdefault(kind_of, []).append(size)
    reach = longest + math.ceil(tolerance * longest) + SPAN + 2
    near = min(reach, PIECED + math.ceil(tolerance * PIECED) + SPAN + 2)
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"), "text")
    if not sizes:
        rows = rows.limit(0)
    pieces = cut_lineage(
        rows.mapInArrow(
            _find(item_bitmap(keys.where("kind = 'walk'")), item_bitmap(keys.where("kind <> 'walk'")), sizes, reach, near),
            f"doc_id {kind}, row long, piece binary, keys array<long>, places array<int>",
        ).withColumn("at", F.monotonically_increasing_id())
    )
    edits = F.floor(F.col("item_bytes") * tolerance)
    span = F.floor((F.col("found.places") - F.col("begin")) / SPAN)
    pairs = (
        pieces.select("at", F.explode(F.arrays_zip("keys", "places")).alias("found"))
        .join(keys.select("key", "item_id", "begin", "item_bytes"), F.col("found.keys") == F.col("key"))
        .select("at", "item_id", "item_bytes", span.alias("span")).distinct()
    )
    # the characters an item that begins in the span may take, edits and a mark at either end included
    begin = F.greatest(F.col("span") * SPAN - edits, F.lit(1))
    end = F.col("span") * SPAN + SPAN + F.col("item_bytes") + edits
    window = F.substr("piece", begin.cast("int"), (end - begin + 2).cast("int"))
    return (
        pairs.join(pieces.drop("keys", "places"), "at").join(folded, "item_id")
        .where(F.length("item") == F.col("item_bytes"))
        .select("doc_id", "row", "item_id", "item_bytes", window.alias("window"), "item")
        .mapInArrow(_verify(tolerance), f"doc_id {kind}, row long, item_id {item_kind}, distance long, item_bytes long")
        .groupBy("doc_id", "row", "item_id")
        .agg(F.min("distance").alias("distance"), F.max("item_bytes").alias("item_bytes"))
    )


def drop_leaks(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    found = cut_lineage(find_leaks(docs, items, tolerance).select(F.col("row").alias("__row")).distinct())
    return docs.join(found, F.xxhash64(F.col("doc_id"), F.col("text")) == F.col("__row"), "left_anti")
