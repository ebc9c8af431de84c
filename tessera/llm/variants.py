"""Spelling variants: near words by a search in a trie of letter-group counts.

Letters fall into ``GROUPS`` groups of about equal use. A word's vector holds
how many letters of each group it has; the trie arranges the words by the first
count, then the second, and so on, and a leaf holds the words of one vector. One
inserted letter makes one count larger by one, one replaced letter makes one
larger and one smaller (or changes none). A search from a word therefore goes
down the trie with a budget of one surplus and one deficit; the words of the
leaves it reaches are verified. From a pair of near words the search finds one
end from the other once: the longer from the shorter, else the vector that
comes later, so the surplus is spent before the deficit.

On Spark the upper levels of the trie are a shuffle: a word goes to the node of
its own counts as a member, and to every node its budget reaches as a visitor
with what is left of it. A task holds the part of the trie below one node as a
sorted array of vectors (five bits a count, so that a node is a range) and
takes blocks of visitors down, deepest first, so that only a few blocks of a
search are held at a time. The depth of the upper levels follows from the
number of words; nodes that still have many members or visitors are dealt to a
grid of (members, visitors) tasks. So no task holds more than ``CELL`` members
and ``VISITS`` visitors, up to what hashes vary.

Null texts have no words. Repeated rows count as often as they occur. Empty
tables give no rows. Words of any length are searched: a count above 31 is
taken as 31, which loses no pair. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import _GRAM, _GRAM_INVERSE, mix, run_hashes, slices
from tessera.session import cut_lineage

GROUPS = 12
BITS = 5
MOST = (1 << BITS) - 1
# members and visitors of a task
CELL = 10_000
VISITS = 25_000
# levels that the shuffle may take
DEPTH = 6
# states or pairs of a search that are looked at together
BLOCK = 1 << 18
# distinct words a counting task holds before it passes them on
HELD = 200_000

# fixed: letters by how often they are used; dealt in turn they make groups of like size
_BY_USE = "etaoinshrdlucmfwypvbgkjqxz"
_GROUP = np.arange(256) % GROUPS
_GROUP[[ord(c) for c in _BY_USE]] = np.arange(26) % GROUPS

_RUN = re.compile(r"[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def count_words(docs: DataFrame, *, least_length: int = 5, drop_every: int | None = 97) -> DataFrame:
    """(word, n) of runs of letters, A-Z lower-cased, of at least ``least_length`` code points.

    With ``drop_every``, a run loses a letter in documents where that number divides the
    crc32 of ``<doc_id>:<run>`` (a null id is written as nothing): the letter at crc32 % length.
    """
    run = re.compile(_RUN.pattern[:-1] + "{%d,}" % least_length)

    def changed(word: str, seed: int) -> str:
        h = zlib.crc32(word.encode(), seed)
        if h % drop_every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    def table(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    def count(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary())
                for doc, text in zip(part.column("id").to_pylist(), texts.to_pylist()):
                    found = Counter(run.findall(text.translate(_LOWER).decode()))
                    if not drop_every:
                        total.update(found)
                        continue
                    seed = zlib.crc32(b"%s:" % (doc or "").encode())
                    for word, n in found.items():
                        total[changed(word, seed)] += n
                    if len(total) > HELD:
                        yield table(total)
                        total = Counter()
        yield table(total)

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(count, "word string, n long")
    return rows.where(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each begins."""
    words = words.to_pylist()
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def vectors(words: pa.Array) -> np.ndarray:
    """Group counts of each word, five bits a group, the first group in the highest."""
    points, first = _letters(words)
    row = np.repeat(np.arange(len(words)), np.diff(first))
    group = np.where(points < 256, _GROUP[np.minimum(points, 255)], points % GROUPS)
    counts = np.bincount(row * GROUPS + group, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return np.minimum(counts, MOST) @ (1 << (BITS * np.arange(GROUPS - 1, -1, -1, dtype=np.int64)))


def _with_vector(vocabulary: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(vectors(batch.column("word")), pa.int64())],
                names=["word", "n", "vector"],
            )

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, vector long")


def _node(depth: int) -> Column:
    return F.shiftright("vector", BITS * (GROUPS - depth))


def _reached(depth: int) -> Column:
    """Nodes of a level that a word's budget reaches: (node, spent), spent 1 a surplus, 2 a deficit as well."""
    states = F.array(F.struct(F.lit(0).cast("long").alias("node"), F.lit(0).alias("spent")))
    for level in range(depth):
        count = F.shiftright("vector", BITS * (GROUPS - 1 - level)).bitwiseAND(F.lit(MOST))
        states = F.flatten(F.transform(states, partial(_below, count)))
    return states


def _below(count: Column, state: Column) -> Column:
    """Nodes one level further down that a state reaches, for a word with ``count`` letters of the group."""
    at = F.shiftleft(state["node"], BITS) + count
    same = F.struct(at.alias("node"), state["spent"].alias("spent"))
    more = F.struct((at + 1).alias("node"), F.lit(1).alias("spent"))
    less = F.struct((at - 1).alias("node"), F.lit(2).alias("spent"))
    return (
        F.when((state["spent"] == 0) & (count < MOST), F.array(same, more))
        .when((state["spent"] == 1) & (count > 0), F.array(same, less)).otherwise(F.array(same))
    )


class Trie:
    """The part of the trie below one node, as sorted vectors with their words."""

    def __init__(self, words: pa.Array, vector: np.ndarray):
        order = np.argsort(vector, kind="stable")
        self.order = order
        self.keys, first = np.unique(vector[order], return_index=True)
        self.first = np.concatenate([first, [len(order)]])
        self.words = Spelled(words)

    def _at(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First vector not below the node of ``keys`` at ``level``, and if the node is there."""
        shift = BITS * (GROUPS - level)
        i = np.searchsorted(self.keys, keys >> shift << shift)
        there = self.keys[np.minimum(i, len(self.keys) - 1)] >> shift == keys >> shift
        return i, there & (i < len(self.keys))

    def leaves(self, keys: np.ndarray, spent: np.ndarray, level: int):
        """Blocks of (visitor, vector number) that the visitors' budgets reach, depth first."""
        stack = [(level, np.arange(len(keys)), keys, spent)]
        while stack:
            level, who, keys, spent = stack.pop()
            if len(who) > BLOCK:
                half = len(who) // 2
                stack += [(level, who[half:], keys[half:], spent[half:]), (level, who[:half], keys[:half], spent[:half])]
                continue
            done = (spent == 2) | (level == GROUPS)
            if done.any():  # nothing left to spend: the rest of the way is the word's own
                i, there = self._at(keys[done], GROUPS)
                if there.any():
                    yield who[done][there], i[there]
                who, keys, spent = who[~done], keys[~done], spent[~done]
            if not len(who):
                continue
            step = np.int64(1) << np.int64(BITS * (GROUPS - 1 - level))
            count = keys // step & MOST
            more, less = (spent == 0) & (count < MOST), (spent == 1) & (count > 0)
            who = np.concatenate([who, who[more], who[less]])
            spent = np.concatenate([spent, np.full(more.sum(), 1), np.full(less.sum(), 2)])
            keys = np.concatenate([keys, keys[more] + step, keys[less] - step])
            there = self._at(keys, level + 1)[1]
            stack.append((level + 1, who[there], keys[there], spent[there]))

    def near(self, words: pa.Array, vector: np.ndarray, keys: np.ndarray, spent: np.ndarray, level: int):
        """Blocks of (visitor, member, of one vector) that differ by one code point; ``keys`` are the ways so far."""
        visitors = Spelled(words)
        for who, leaf in self.leaves(keys, spent, level):
            counts = self.first[leaf + 1] - self.first[leaf]
            ends = np.cumsum(counts)
            for low in range(0, int(ends[-1]), BLOCK):
                at = np.arange(low, min(low + BLOCK, int(ends[-1])))
                i = np.searchsorted(ends, at, "right")
                member = self.order[self.first[leaf[i]] + at - (ends[i] - counts[i])]
                visitor = who[i]
                maybe = visitors.share_half(visitor, self.words, member)
                visitor, member, same = visitor[maybe], member[maybe], (vector[who[i]] == self.keys[leaf[i]])[maybe]
                found = visitors.one_apart(visitor, self.words, member)
                yield visitor[found], member[found], same[found]


class Spelled:
    """Words as code points, with hashes of their halves."""

    def __init__(self, words: pa.Array):
        self.points, self.first = _letters(words)
        self.length = np.diff(self.first)
        a, b = self.first[:-1], self.first[1:]
        values = mix(self.points.astype(np.uint64), 5)

        def of(start, end):
            return run_hashes(values, _GRAM, _GRAM_INVERSE, start, end)

        half, less = self.length // 2, np.maximum(self.length - 1, 0)
        self.halves = of(a, a + half), of(a + half, b)
        # the halves of a word that lacks one letter: as much of the start, as much of the end
        self.lacking = of(a, a + less // 2), of(b - (less - less // 2), b)

    def share_half(self, i: np.ndarray, other: Spelled, j: np.ndarray) -> np.ndarray:
        """Pairs whose lengths fit and whose first or last halves agree, which all near pairs' do."""
        longer = other.length[j] - self.length[i]
        head = np.where(longer == 0, other.halves[0][j], other.lacking[0][j]) == self.halves[0][i]
        tail = np.where(longer == 0, other.halves[1][j], other.lacking[1][j]) == self.halves[1][i]
        return (head | tail) & ((longer == 0) | (longer == 1))

    def one_apart(self, i: np.ndarray, other: Spelled, j: np.ndarray) -> np.ndarray:
        """Pairs with exactly one letter replaced, or one more in the second word."""
        out = np.zeros(len(i), bool)
        order = np.argsort(other.length[j], kind="stable")
        low = 0
        while low < len(order):
            width = max(int(other.length[j[order[low]]]), 1)
            high = min(len(order), low + max(1, BLOCK // (2 * width)))
            pick = order[low:high]
            width = int(other.length[j[pick[-1]]])
            while width * len(pick) > 4 * BLOCK and len(pick) > 1:
                pick = pick[: len(pick) // 2]
                width = int(other.length[j[pick[-1]]])
            u, v = self._padded(i[pick], width), other._padded(j[pick], width + 1)
            differ = u != v[:, :-1]
            replaced = differ.sum(1) == 1
            # after the first difference the longer word goes on one letter later
            start = np.where(differ.any(1), differ.argmax(1), width)
            later = np.arange(width) >= start[:, None]
            inside = np.arange(width) < self.length[i[pick]][:, None]
            inserted = ~((u != v[:, 1:]) & later & inside).any(1)
            out[pick] = np.where(other.length[j[pick]] == self.length[i[pick]], replaced, inserted)
            low += len(pick)
        return out

    def _padded(self, i: np.ndarray, width: int) -> np.ndarray:
        at = np.arange(width)
        inside = at < self.length[i][:, None]
        return np.where(inside, self.points[np.minimum(self.first[i][:, None] + at, len(self.points) - 1)], 0)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n) of distinct words -> (word, near, near_n), every near pair in both directions."""
    words = cut_lineage(_with_vector(vocabulary))
    depth = 1
    while depth < DEPTH and (words.groupBy(_node(depth)).count().agg(F.max("count")).first()[0] or 0) > CELL:
        depth += 1
    visits = words.select("*", F.explode(_reached(depth)).alias("__to")).select(
        F.col("__to.node").alias("node"), F.col("word").alias("guest"), F.col("n").alias("guest_n"),
        F.col("vector").alias("guest_vector"), F.col("__to.spent").alias("spent"),
    )
    members = words.select(_node(depth).alias("node"), "word", "n", "vector")
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("members")).join(
        visits.groupBy("node").agg(F.count(F.lit(1)).alias("visits")), "node"
    )
    nodes = cut_lineage(
        sizes.select("node", F.ceil(F.col("members") / CELL).alias("rows"), F.ceil(F.col("visits") / VISITS).alias("columns"))
    )

    def dealt(word: str, count: str) -> Column:
        return F.pmod(F.xxhash64(word), F.col(count))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = members.join(nodes, "node").select(
        "node", dealt("word", "rows").alias("row"), every("columns").alias("column"), "word", "n", "vector"
    )
    right = visits.join(nodes, "node").select(
        "node", every("rows").alias("row"), dealt("guest", "columns").alias("column"),
        "guest", "guest_n", "guest_vector", "spent",
    )
    shift = BITS * (GROUPS - depth)

    def search(members: pa.Table, visitors: pa.Table) -> pa.Table:
        names = ["word", "near", "near_n"]
        out = [pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], names)]
        if len(members) and len(visitors):
            own, guests = members.column("word").combine_chunks(), visitors.column("guest").combine_chunks()
            trie = Trie(own, members.column("vector").to_numpy())
            vector = visitors.column("guest_vector").to_numpy()
            # the counts above this node are the node's, those below the word's own
            node = np.int64(visitors.column("node")[0].as_py())
            keys = (node << shift) | (vector & ((np.int64(1) << shift) - 1))
            n, m = visitors.column("guest_n").combine_chunks(), members.column("n").combine_chunks()
            spent = visitors.column("spent").to_numpy()
            for i, j, same in trie.near(guests, vector, keys, spent, depth):
                # two words of one vector meet from both sides: the first leads to the second
                i, j = pa.array(i), pa.array(j)
                a, b, na, nb = guests.take(i), own.take(j), n.take(i), m.take(j)
                shorter = pc.less(pc.utf8_length(a), pc.utf8_length(b))
                keep = pc.or_(pc.or_(shorter, pc.less(a, b)), pa.array(~same))
                t = pa.table([a, b, na, nb], ["a", "b", "na", "nb"]).filter(keep)
                out += [t.select(["a", "b", "nb"]).rename_columns(names), t.select(["b", "a", "na"]).rename_columns(names)]
        return pa.concat_tables(out)

    grid = ["node", "row", "column"]
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root), the last word on the way over forms; no way may lead back.

    Every round doubles how far a word sees.
    """
    hops = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        hops = cut_lineage(
            hops.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        )
        if not hops.agg(F.max(F.col("moved").cast("int"))).first()[0]:
            return hops.drop("moved")
        hops = hops.drop("moved")


def spelling_groups(vocabulary: DataFrame, *, ratio: int = 2) -> DataFrame:
    """(word, n) of distinct words -> word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (then the smallest), if that n is at least
    ``ratio`` times the word's own; its root is what the forms lead to, else the word.
    """
    vocabulary = cut_lineage(vocabulary.select("word", "n"))
    best = near_pairs(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    large = -F.col("best.minus") >= ratio * F.col("n")
    formed = cut_lineage(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"),
        )
    )
    found = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
