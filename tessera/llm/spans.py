"""Long repeated spans by compaction of a De Bruijn graph of word k-mers.

A word run of ``SPAN`` words that starts in two documents is a repeated
window; the words it covers go from every document but the one with the
smallest id. The graph makes this cheap:

1. Of the k-mers of a window the one with the smallest hash is kept, so every
   window holds a kept k-mer and equal windows hold the same one. Kept k-mers
   are the nodes; the words from one kept k-mer of a text to the next are an
   edge, named by their hash, with the text's ends as edges of their own.
2. One grouped aggregate per node gives its smallest and largest document and
   whether all its occurrences have the same two edges (a nonbranching node).
3. The repeated nodes are joined back to their documents. A path of
   nonbranching nodes runs through the same words in every document that has
   one of its nodes, so every window inside a compacted path is decided by the
   smallest document of its node. A window whose node one document only has is
   not repeated. No k-mer needs to be followed step by step.
4. What is left are windows across a branching node. They are read from the
   source text by their coordinates, hashed whole, and grouped.

Shuffles carry about one node per 20 words, the texts once, the texts with
open windows once more, and the open windows. A hot node is pre-aggregated
before its shuffle, and joined back by a join Spark can split.

Words are compared by 64-bit hashes. Null text has no words. A row with a null
id neither loses words nor takes them from others. Rows with equal ids are not
smaller than each other, so they do not touch each other's words. Texts
shorter than a window are kept whole. Columns besides id and text are unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, list_column, mix, per_slice, signed
from tessera.session import cut_lineage

SPAN = 50
KMER = 10


class Nodes:
    """The kept k-mers of the texts of a slice, in text order."""

    def __init__(self, words: Words, span: int = SPAN, kmer: int = KMER):
        self.words, self.span, self.kmer = words, span, kmer
        self.hash = words.hashes()
        windows = words.windows(span)
        grams = np.zeros(len(words), np.uint64)
        at = words.windows(kmer)
        grams[at] = words.gram_hashes(self.hash, at, kmer)
        places = _smallest(grams, windows, span - kmer + 1)
        self.at = np.unique(places)
        # the node of every window, and the first window of every text
        self.of_window = np.searchsorted(self.at, places)
        self.first_window = np.searchsorted(windows, words.first)
        self.node = grams[self.at]
        self.first = np.searchsorted(self.at, words.first)
        self.row = np.repeat(np.arange(len(words.counts)), np.diff(self.first))

    def contexts(self) -> np.ndarray:
        """One hash of the two edges at each node."""
        words, at = self.words, self.at
        if not len(at):
            return np.zeros(0, np.uint64)
        head = np.zeros(len(at), bool)
        head[self.first[:-1][np.diff(self.first) > 0]] = True
        tail = np.roll(head, -1)
        start = np.where(head, words.first[self.row], np.roll(at, 1))
        end = np.where(tail, words.first[self.row + 1], np.roll(at, -1) + self.kmer)
        left = words.gram_hashes(self.hash, start, at + self.kmer - start) + head
        right = words.gram_hashes(self.hash, at, end - at) + tail
        return mix(mix(left, 5) + right, 6)


def _smallest(values: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """For every window the place of the first smallest of its ``width`` values."""
    if not len(windows):
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    keys = (values & ~low) | (np.arange(len(values), dtype=np.uint64) & low)
    reach, best = 1, keys
    while 2 * reach <= width:
        best = np.minimum(best[: len(best) - reach], best[reach:])
        reach *= 2
    best = np.minimum(best[windows], best[windows + width - reach])
    place = (best & low).astype(np.int64)
    place += (windows - place + int(low)) // (int(low) + 1) * (int(low) + 1)  # texts of more than 2^24 words
    return place


def _emit_nodes(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    nodes = Nodes(words)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(nodes.node)), part.column("doc_id").take(pa.array(nodes.row)), pa.array(signed(nodes.contexts()))],
        ["node", "doc_id", "context"],
    )


def _digest(words: Words, row: int, removed: np.ndarray | None) -> str:
    """SHA-256 of the kept words of a text, joined by single spaces."""
    text = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()
    if removed is not None:
        text = [w for w, gone in zip(text, removed.tolist()) if not gone]
    return hashlib.sha256(b" ".join(text)).hexdigest()


def _cover(starts: np.ndarray, n: int, span: int) -> np.ndarray:
    """Words covered by windows at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + span, -1)
    return np.cumsum(change[:-1]) > 0


OPEN, STAYS, GOES = 0, 1, 2


def _windows_of_path(at, of_window, repeated, plain, mine, n: int, span: int, kmer: int) -> np.ndarray:
    """State of every window of one text from its nodes.

    ``at`` are the node places, ``of_window`` the node of each window;
    ``repeated``, ``plain`` (nonbranching) and ``mine`` (no smaller document
    has the node) are flags of the nodes. Equal windows have equal nodes, so a
    window whose node no other document has stays, and one that lies between
    the ends of its node's path is decided by that node.
    """
    count = len(at)
    left, right = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for i in range(count):
        left[i] = 0 if i == 0 else left[i - 1] if plain[i - 1] else at[i - 1]
    for i in range(count - 1, -1, -1):
        right[i] = n if i == count - 1 else right[i + 1] if plain[i + 1] else at[i + 1] + kmer
    start = np.arange(n - span + 1)
    inside = plain[of_window] & (left[of_window] <= start) & (start + span <= right[of_window])
    state = np.where(inside, np.where(mine[of_window], STAYS, GOES), OPEN)
    return np.where(repeated[of_window], state, STAYS)


def _decide(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    """Settle the windows inside compacted paths; list the others."""
    nodes = Nodes(words)
    ids, flags = part.column("doc_id"), part.column("flags")
    known = flags.is_valid().to_numpy(zero_copy_only=False)
    removed_words, digests, texts = [], [], []
    goes, starts, hashes = [], [], []
    for row in range(part.num_rows):
        n = int(words.counts[row])
        gone, open_at = None, np.zeros(0, np.int64)
        settled = np.zeros(0, np.int64)
        if known[row] and n >= nodes.span:
            mine = flags[row].values
            order = np.argsort(node := mine.field("node").to_numpy())
            node = node[order]
            plain_of = mine.field("plain").to_numpy(zero_copy_only=False)[order]
            first_of = mine.field("own").to_numpy(zero_copy_only=False)[order]
            here = slice(nodes.first[row], nodes.first[row + 1])
            value = signed(nodes.node[here])
            at = np.minimum(np.searchsorted(node, value), len(node) - 1)
            repeated = node[at] == value
            own = nodes.of_window[nodes.first_window[row] : nodes.first_window[row + 1]] - nodes.first[row]
            state = _windows_of_path(
                nodes.at[here] - words.first[row], own, repeated, repeated & plain_of[at], first_of[at], n, nodes.span, nodes.kmer
            )
            settled, open_at = np.flatnonzero(state == GOES), np.flatnonzero(state == OPEN)
            if len(settled) and not len(open_at):
                gone = _cover(settled, n, nodes.span)
        goes.append(settled if len(open_at) else settled[:0])
        starts.append(open_at + words.first[row])
        removed_words.append(0 if gone is None else int(gone.sum()))
        digests.append(None if len(open_at) else _digest(words, row, gone))
        texts.append(part.column("text")[row] if len(open_at) else None)
    all_starts = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
    hashes = words.gram_hashes(nodes.hash, all_starts, nodes.span) if len(all_starts) else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(words.counts), pa.array(removed_words, pa.int64()), pa.array(digests, pa.string()),
            pa.array(texts, pa.string()),
            list_column(np.concatenate([*goes, np.zeros(0, np.int64)]).astype(np.int32), [len(x) for x in goes], pa.int32()),
            list_column(signed(hashes), [len(x) for x in starts], pa.int64()),
        ],
        ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "goes", "windows"],
    )


def _finish(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    """Result of texts whose open windows are decided: ``found`` holds the repeated ones."""
    span, removed, digests = SPAN, [], []
    hashes = words.hashes()
    at = words.windows(span)
    grams = signed(words.gram_hashes(hashes, at, span)) if len(at) else np.zeros(0, np.int64)
    first = np.searchsorted(at, words.first)
    for row in range(part.num_rows):
        n = int(words.counts[row])
        goes = part.column("goes")[row].values.to_numpy().astype(np.int64)
        found = part.column("found")[row]
        if found.is_valid:
            own = grams[first[row] : first[row + 1]]
            goes = np.union1d(goes, np.flatnonzero(np.isin(own, found.values.to_numpy())))
        gone = _cover(goes, n, span)
        removed.append(int(gone.sum()))
        digests.append(_digest(words, row, gone))
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
        ["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    named = docs.where(F.col("doc_id").isNotNull())
    nodes = named.mapInArrow(per_slice(_emit_nodes), f"node long, doc_id {kind}, context long")
    # written, so that Spark can split a hot node's side of the join
    repeated = cut_lineage(
        nodes.groupBy("node")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("context") == F.max("context")).alias("plain"))
        .where("low < high").select("node", "low", "plain")
    )
    flags = (
        nodes.select("node", "doc_id").join(repeated, "node")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("node", "plain", (F.col("low") == F.col("doc_id")).alias("own"))).alias("flags"))
    )
    decided = cut_lineage(
        docs.join(flags, "doc_id", "left").mapInArrow(
            per_slice(_decide),
            f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, text string, goes array<int>, windows array<long>",
        )
    )
    open_rows = decided.where("kept_sha256 is null")
    windows = open_rows.select("doc_id", F.explode(F.array_distinct("windows")).alias("window"))
    owners = cut_lineage(
        windows.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high").select("window", "low")
    )
    found = (
        windows.join(owners, "window").where("doc_id > low")
        .groupBy("doc_id").agg(F.collect_set("window").alias("found"))
    )
    finished = open_rows.select("doc_id", "text", "goes").join(found, "doc_id", "left").mapInArrow(
        per_slice(_finish), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    )
    return decided.where("kept_sha256 is not null").select(*finished.columns).unionByName(finished)
