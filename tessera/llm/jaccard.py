"""Exact Jaccard join of word-shingle sets, and the groups its links make.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric, and so is the size
of the symmetric difference, |x - y| + |y - x|. Sets are linked if their
difference is at most a share of their sizes, (1 - s)(|x| + |y|) / (1 + s).
Documents lie so far apart (nearly all pairs share nothing) that whole
documents are useless as first pivots: within the window of the triangle
inequality every document would be copied to every region. The pivots of the
first level are therefore small sets, and documents take over below:

1. First level. The hash order of the shingles cuts a document's set into
   pieces, and the pieces it holds are its nearest pivots. The difference of
   linked sets is bounded, and so are the pieces in which they can differ; a
   document is copied to just so many of its pivots' regions that linked
   documents meet in one of them. ``single`` pivots are one shingle each: the
   first floor(|x| - s|x|) + m of x are enough to meet m times, in an order that
   has those common in a sample of the documents last; sets and pairs that meet
   less often are no candidates. ``pieces`` cuts the hash range
   into more parts than the difference has elements, for all documents of a
   size class, so that one part is equal as a whole; documents at the upper
   edge of a class are copied to the next. Pieces hold several shingles, which
   keeps documents apart that share only common ones.
   In regions of up to ``FEW_SETS`` sets each pair's meetings are counted. Pairs
   that meet often enough, or could with what larger regions add, are compared
   in full. Only sets that are in enough larger regions go on to the cells.
2. The smallest document q of a larger region is its pivot; of pivots with close
   sketches the smallest takes all. The documents of one pivot make its cell. The exact difference of each member and q is taken
   from the whole sets. Members close enough to q are linked. A cell whose
   other members are in one group already is done.
3. A cell is joined again about a centre c, q with the changes that most of
   (up to ``CENTRE_MEMBERS`` of) its members share; any set would do. Two
   members differ from each other by the symmetric difference of their
   differences from c, which are short. Members whose differences are so short
   that they must be linked hang on the one with the most room left, by the
   triangle inequality, without being paired. Other linked members share so
   many elements of their differences that one lies among the first few of
   both, in an order that has what c lacks before what c has: a member goes to
   the regions of just these elements. Members of different groups that meet
   there, and whose distances from the centre the triangle inequality and the
   place of the element allow, are compared, first by short sketches, then in
   full.

Only links between different groups are looked for, so copies are never paired
off, and a set that many documents share is one member. Sets are named by
64-bit hashes of all their shingles and compared by 64-bit shingle hashes.

Null text and text without words make an empty set: linked with nothing, its
own group. Rows with a null id are linked with nothing and have no group.
Rows with equal ids are one document for the groups. Other columns are unread.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.words import Words, list_column, mix, per_slice, signed
from tessera.session import cut_lineage, release

CLASS_RATIO = 1.5
# parts with fewer shingles are not used as pivots where others suffice
LEAST_IN_PART = 2
# bytes of a set's sketch, which rules out most pairs before their sets are compared
BUCKETS = 256
# members of a cell that its centre is taken from, about; the centre changes the cost only
CENTRE_MEMBERS = 16
# a cell with more members is measured in parts
CELL_ROWS = 2000
# cells are measured in so many turns, so that only a part of the sets is on its way at a time
TURNS = 4
# ``single`` pivots: documents and counts by which common shingles are known, and how many are kept
SAMPLE_DOCS = 5000
COMMON_TIMES = 3
COMMON_MOST = 1 << 18
# linked sets meet in so many regions of ``single`` pivots, and large ones in more
LEAST_MEETINGS = 6
# the sets of a region are paired one by one if there are at most so many; cells take the larger regions
FEW_SETS = 16


class Sets:
    """The distinct shingles of each text of a slice, in hash order."""

    def __init__(self, words: Words, size: int):
        hashes = words.hashes(lower=True)
        short = (words.counts > 0) & (words.counts < size)
        at = np.concatenate([words.windows(size), words.first[:-1][short]])
        lengths = np.concatenate([np.full(len(at) - short.sum(), size), words.counts[short]]).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, lengths = at[order], lengths[order]
        values = words.gram_hashes(hashes, at, lengths) if len(at) else np.zeros(0, np.uint64)
        first = np.searchsorted(at, words.first)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            values[a:b].sort()
        row = np.repeat(np.arange(len(words.counts)), np.diff(first))
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        self.values, self.row = values[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(words.counts) + 1))
        self.counts = np.diff(self.first)
        self.name = signed(mix(self.sums(mix(self.values, 11)) + self.counts.astype(np.uint64), 12))

    def sketches(self) -> list[bytes]:
        """How many shingles fall into each of ``BUCKETS`` buckets, one byte each.

        The sum of the differences of two sketches is at most the number of
        shingles that one set has and the other has not.
        """
        place = self.row * BUCKETS + (self.values & np.uint64(BUCKETS - 1)).astype(np.int64)
        counts = np.bincount(place, minlength=len(self.counts) * BUCKETS)
        return [x.tobytes() for x in np.minimum(counts, 255).astype(np.uint8).reshape(-1, BUCKETS)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def meetings(counts: np.ndarray) -> np.ndarray:
    """In how many regions of ``single`` pivots two linked sets of these sizes meet, if they share so many shingles."""
    return np.maximum(LEAST_MEETINGS, -(-counts // 20))


def least_meetings(counts: np.ndarray, percent: int) -> np.ndarray:
    """In how many regions a set meets any set it is linked with: its partner may be smaller."""
    least = -(-counts * percent // 100)
    return np.minimum(least, meetings(least))


def _first_shingles(sets: Sets, percent: int, chosen: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``single`` pivots: (pivot, row) for the chosen rows; ``common`` shingles come last in the order."""
    need = np.minimum(sets.counts, sets.counts - -(-sets.counts * percent // 100) + meetings(sets.counts))
    need = np.where(chosen & (sets.counts > 0), need, 0)
    late = np.zeros(len(sets.values), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, sets.values), len(common) - 1)] == sets.values
    order = np.lexsort((sets.values, late, sets.row))
    place = np.arange(len(order)) - sets.first[sets.row]  # rows keep their lengths and their order
    use = order[place < need[sets.row]]
    return sets.values[use], sets.row[use]


def size_classes(largest: int) -> np.ndarray:
    """Lower bounds of the size classes up to one beyond ``largest``."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO)))
    return np.array([*bounds, max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO))], np.int64)


def parts_of_class(bounds: np.ndarray, kind: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest symmetric difference of two linked sets of a class, and its number of parts."""
    differ = (100 - percent) * 2 * (bounds[kind + 1] - 1) // (100 + percent)
    spare = np.where(differ >= 8, -(-6 * (differ + 1) // 100) + 1, 0)
    return differ, differ + 1 + spare


def _pieces(sets: Sets, percent: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pieces`` pivots: (pivot, row) for the chosen rows, in their class and the next if they reach it."""
    bounds = size_classes(int(sets.counts.max(initial=1)))
    own = np.maximum(np.searchsorted(bounds, sets.counts, "right") - 1, 0)
    out = []
    for up in (0, 1):
        kind = own + up
        rows = chosen & (sets.counts > 0)
        if up:
            rows &= sets.counts * 100 // percent >= bounds[np.minimum(kind, len(bounds) - 1)]
        kind = np.minimum(kind, len(bounds) - 2)
        differ, parts = parts_of_class(bounds, kind, percent)
        rows &= differ > 0  # else only equal sets are linked
        use = rows[sets.row]
        if use.any():
            out.append(_cut(sets.values[use], sets.row[use], kind, differ, parts))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _cut(values, row, kind, differ, parts) -> tuple[np.ndarray, np.ndarray]:
    """Name the parts of each row's set by class, place and content."""
    part = ((values >> np.uint64(32)) * parts[row].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(values), bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(values)))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values, 13), out=total[1:])
    content = total[start + sizes] - total[start]
    of, place = row[start], part[start]
    full = sizes >= LEAST_IN_PART
    # two linked rows agree on parts - differ parts at least; with fewer small ones a full one is among them
    small = parts - np.bincount(of[full], minlength=len(parts))
    scant = small >= parts - differ
    names = [mix(content + mix(place + (kind[of].astype(np.uint64) << np.uint64(32)), 14))]
    use = full | scant[of]
    out, rows = [names[0][use]], [of[use]]
    for r in np.unique(of[scant[of]]):  # rare: these also meet in parts that are empty in both
        empty = np.setdiff1d(np.arange(parts[r], dtype=np.uint64), place[of == r])
        out.append(mix(mix(empty + (np.uint64(kind[r]) << np.uint64(32)), 14)))
        rows.append(np.full(len(empty), r))
    return np.concatenate(out), np.concatenate(rows)


def _emit_sets(size: int):
    def run(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        sets = Sets(words, size)
        empty = sets.counts == 0
        sketches = [None if e else x for e, x in zip(empty.tolist(), sets.sketches())]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sets.counts), pa.array(sets.name, mask=empty), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "set", "sketch"],
        )

    return per_slice(run)


def _emit_pivots(size: int, percent: int, pivots: str, common: np.ndarray):
    def run(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        sets = Sets(words, size)
        chosen = np.zeros(len(sets.counts), bool)
        chosen[np.unique(sets.name, return_index=True)[1]] = True  # a set once per slice
        if pivots == "single":
            pivot, row = _first_shingles(sets, percent, chosen, common)
        else:
            pivot, row = _pieces(sets, percent, chosen)
        need = least_meetings(sets.counts, percent) if pivots == "single" else np.ones(len(sets.counts))
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(pivot)), pa.array(sets.name[row]), pa.array(need[row].astype(np.int32))], ["region", "set", "need"]
        )

    return per_slice(run)


def _emit_all(size: int):
    def run(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(Sets(words, size).values))], ["shingle"])

    return per_slice(run)


def common_shingles(docs: DataFrame, count: int, size: int) -> np.ndarray:
    """Shingles that ``COMMON_TIMES`` or more of about ``SAMPLE_DOCS`` documents have, sorted.

    They are no good as pivots and come last in their order; any order gives the same groups.
    """
    share = int(min(1.0, SAMPLE_DOCS / max(count, 1)) * (1 << 30))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share)
    counted = sample.select("text").mapInArrow(_emit_all(size), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    top = counted.where(F.col("n") >= COMMON_TIMES).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST)
    return np.sort(top.select("shingle").toArrow().column(0).to_numpy().view(np.uint64))


def _emit_members(size: int):
    """A row for each cell that asks for a set: pivots for every part of their cell, members for one."""

    def run(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        sets = Sets(words, size)
        asks = part.column("asks")
        right = sets.name == part.column("wanted").to_numpy(zero_copy_only=False)
        counts = np.where(right, pc.list_value_length(asks).to_numpy(zero_copy_only=False), 0)
        row = np.repeat(np.arange(part.num_rows), counts)
        chosen = asks.filter(pa.array(right)).flatten()
        lists = list_column(signed(sets.values), sets.counts, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*[chosen.field(c) for c in ("a", "part", "member")], pa.array(sets.name[row]), lists.take(pa.array(row))],
            ["a", "part", "member", "b", "shingles"],
        )

    return per_slice(run)


def _linked(pairs: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    """The (cell, a, b) pairs that are linked: what differs between two members is what differs in their differences."""

    def side(name: str) -> DataFrame:
        return measured.select(
            F.col("a").alias("cell"), F.col("b").alias(name), F.col("n_b").alias(f"n_{name}"),
            F.col("added").alias(f"added_{name}"), F.col("gone").alias(f"gone_{name}"),
        )

    both = pairs.join(side("a"), ["cell", "a"]).join(side("b"), ["cell", "b"])
    sizes = [F.size(f"{kind}_{name}") for kind in ("added", "gone") for name in ("a", "b")]
    common = F.size(F.array_intersect("added_a", "added_b")) + F.size(F.array_intersect("gone_a", "gone_b"))
    differ = sizes[0] + sizes[1] + sizes[2] + sizes[3] - 2 * common
    return both.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _differences(batches):
    """Per member: sizes, and the shingles that it adds to its pivot and that are gone from it.

    Rows come sorted by cell, part of a cell and kind, so that a part's pivot is before its members.
    """
    at, pivot = None, None
    for batch in batches:
        rows = {"a": [], "b": [], "n_a": [], "n_b": []}
        added, gone = [], []
        keys = zip(*[batch.column(c).to_pylist() for c in ("a", "part", "member", "b")])
        for (a, part, member, b), shingles in zip(keys, batch.column("shingles")):
            own = shingles.values.to_numpy().view(np.uint64)
            if not member:
                at, pivot = (a, part), own.copy()
            elif at == (a, part):
                for c, v in zip(rows, (a, b, len(pivot), len(own))):
                    rows[c].append(v)
                added.append(np.setdiff1d(own, pivot, assume_unique=True))
                gone.append(np.setdiff1d(pivot, own, assume_unique=True))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(v, pa.int64()) for v in rows.values()], _lists(added), _lists(gone)], [*rows, "added", "gone"]
        )


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return list_column(signed(values), [len(x) for x in parts], pa.int64())


def _about_centre(percent: int):
    """Per (a, b): the size of the difference of b and the centre of cell a, and its first elements."""

    def run(batches):
        for batch in batches:
            differ, heads = [], []
            sets = [[x.values.to_numpy().view(np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in batch.column(c)]
                    for c in ("added", "gone", "centre_added", "centre_gone")]
            for added, gone, plus, minus, n in zip(*sets, batch.column("n_b").to_pylist()):
                # what the centre has changed in a and b has not
                lacks, has = np.setdiff1d(plus, added), np.setdiff1d(minus, gone)
                added = np.union1d(np.setdiff1d(added, plus), has)
                gone = np.union1d(np.setdiff1d(gone, minus), lacks)
                most = _largest_bound(n, percent) + 1
                differ.append(len(added) + len(gone))
                heads.append(np.concatenate([added[:most], gone[: max(0, most - len(added))]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), batch.column("n_b"), pa.array(differ, pa.int64()), _lists(heads)],
                ["a", "b", "n_b", "differ", "head"],
            )

    return run


def _centres(measured: DataFrame, percent: int) -> DataFrame:
    """(a, centre_added, centre_gone): changes of cell a that more than half of the members looked at have.

    Members further from the pivot than two links are not looked at; a cell
    with fewer than two others keeps its pivot as the centre.
    """
    apart = F.size("added") + F.size("gone")
    near = measured.where((100 + percent) * apart <= 2 * (100 - percent) * (F.col("n_a") + F.col("n_b")))
    cells = cut_lineage(near.groupBy("a").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    looked = near.join(cells, "a").where(F.pmod(F.xxhash64("b"), F.col("members")) < CENTRE_MEMBERS)
    return looked.groupBy("a").agg(F.collect_list("added").alias("added"), F.collect_list("gone").alias("gone")).mapInArrow(
        _common, "a long, centre_added array<long>, centre_gone array<long>"
    )


def _common(batches):
    """Per cell the elements that more than half of its lists have."""
    for batch in batches:
        out = []
        for c in ("added", "gone"):
            out.append([])
            for lists in batch.column(c):
                values, times = np.unique(lists.values.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
                out[-1].append(values[2 * times > len(lists)])
        yield pa.RecordBatch.from_arrays([batch.column("a"), *map(_lists, out)], ["a", "centre_added", "centre_gone"])


def _largest_bound(n: int, percent: int) -> int:
    """Bound on the difference of a set of ``n`` shingles and any set it is linked with."""
    return (100 - percent) * n // percent


def _emit_heads(batches):
    """A row for each of the first elements of a member's difference from its centre."""
    for batch in batches:
        heads = batch.column("head")
        counts = pc.list_value_length(heads).to_numpy(zero_copy_only=False).astype(np.int64)
        which = np.repeat(np.arange(batch.num_rows), counts)
        values = heads.flatten().to_numpy().view(np.uint64)
        cell = mix(batch.column("a").to_numpy().view(np.uint64), 15)
        place = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        at = pa.array(which)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(mix(values + cell[which], 16))), pa.array(place.astype(np.int32)),
             *[batch.column(c).take(at) for c in ("a", "b", "group", "n_b", "differ")]],
            ["key", "place", "cell", "set", "group", "n", "differ"],
        )


def _may_link(percent: int):
    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("__s", "__t"))
            differ = np.abs(one.astype(np.int16) - two).sum(axis=1)
            sizes = batch.column("sizes").to_numpy()
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield out.filter(pa.array(differ * (100 + percent) <= (100 - percent) * sizes))

    return run


def _near(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose sketches do not rule out a link."""
    one = shingles.select(F.col("set").alias("b"), F.col("sketch").alias("__s"), F.col("n").alias("__m"))
    two = shingles.select(F.col("set").alias("a"), F.col("sketch").alias("__t"), F.col("n").alias("__n"))
    both = pairs.join(one, "b").join(two, "a")
    return both.select("a", "b", "__s", "__t", (F.col("__m") + F.col("__n")).alias("sizes")).mapInArrow(
        _may_link(percent), "a long, b long"
    )


def _fewer_pivots(stars: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) with pivots whose sketches are close merged into the smallest; any merging is exact."""
    pivots = stars.select(F.col("a").alias("b")).distinct()
    close = _near(cut_lineage(stars.join(pivots, "b").select("a", "b")), known, percent)
    root = cut_lineage(components(cut_lineage(close.select(F.col("a").alias("u"), F.col("b").alias("v")))))
    moved = stars.join(root.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("component", "a").alias("a"), "b")
    own = root.select(F.col("component").alias("a"), F.col("node").alias("b"))
    fewer = cut_lineage(moved.unionByName(own).where("a <> b").distinct())
    release(stars, root)
    return fewer


def _often_met(members: DataFrame) -> DataFrame:
    """Members without the sets that are in too few shared regions to be linked with any."""
    busy = cut_lineage(
        members.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("set")
    )
    often = cut_lineage(members.join(busy, "set"))
    release(members, busy)
    return often


def _pairs_met(few: DataFrame, many: DataFrame) -> DataFrame:
    """(a, b) pairs that can be linked by what they share in regions of ``few`` sets.

    Linked sets meet ``need`` times. They meet in no more regions of ``many``
    sets than either is in, so the rest of their meetings is in ``few``; of two
    sets that are often enough in ``many``, those that meet there are left to the cells.
    """
    lists = few.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("set", "need"))).alias("sets"))

    def later(x, i):
        rest = F.slice("sets", i + 2, F.size("sets"))
        return F.transform(rest, lambda y: F.struct(x["set"].alias("a"), y["set"].alias("b"), F.greatest(x["need"], y["need"]).alias("need")))

    # near copies share many regions: equal lists are paired once
    each = lists.groupBy("sets").agg(F.count(F.lit(1)).alias("times")).select(
        "times", F.explode(F.flatten(F.transform("sets", later))).alias("pair")
    )
    met = each.groupBy("pair.a", "pair.b").agg(F.sum("times").alias("times"), F.max("pair.need").alias("need"))
    elsewhere = cut_lineage(many.groupBy("set").agg(F.count(F.lit(1)).alias("n")))
    for c in ("a", "b"):
        met = met.join(elsewhere.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    most = F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    enough = (F.col("times") >= F.col("need")) | ((most < F.col("need")) & (F.col("times") + most >= F.col("need")))
    pairs = cut_lineage(met.where(enough).select("a", "b"))
    release(elsewhere)
    return pairs


def _asks(stars: DataFrame) -> DataFrame:
    """(set, asks): the cells, and parts of large cells, that need a set, and whether as pivot or member."""
    parts = cut_lineage(stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("parts")))
    members = stars.join(parts, "a").select(
        F.col("b").alias("set"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(True).alias("member")
    )
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    pivots = parts.select(F.col("a").alias("set"), "a", each.alias("part"), F.lit(False).alias("member"))
    return members.unionByName(pivots).groupBy("set").agg(F.collect_list(F.struct("a", "part", "member")).alias("asks"))


def _measured(usable: DataFrame, known: DataFrame, stars: DataFrame, size: int, finish=lambda found: found) -> list[DataFrame]:
    """What members add to their pivots and what is gone from them, after ``finish``, a table for each turn."""
    asked = known.select(F.col("set").alias("wanted"), "doc_id").join(_asks(stars).withColumnRenamed("set", "wanted"), "wanted")
    held = cut_lineage(usable.join(asked, "doc_id"))
    turns = []
    for turn in range(TURNS):
        now = F.filter("asks", lambda x: F.pmod(F.xxhash64(x["a"], x["part"]), F.lit(TURNS)) == turn)
        asked = held.withColumn("asks", now).where(F.size("asks") > 0)
        turns.append(cut_lineage(finish(
            asked.mapInArrow(_emit_members(size), "a long, part long, member boolean, b long, shingles array<long>")
            .repartition("a", "part").sortWithinPartitions("a", "part", "member")
            .mapInArrow(_differences, "a long, b long, n_a long, n_b long, added array<long>, gone array<long>")
        )))
    release(held)
    return turns


def set_groups(docs: DataFrame, sets: DataFrame, *, size: int, percent: int, pivots: str) -> DataFrame:
    """(set, group) for every set that is linked with another one; ``sets`` has (doc_id, n_shingles, set, sketch)."""
    usable = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    common = common_shingles(usable, sets.count(), size) if pivots == "single" else np.zeros(0, np.uint64)
    placed = usable.mapInArrow(_emit_pivots(size, percent, pivots, common), "region long, set long, need int")
    # written, so that Spark can split a hot region's side of the joins
    repeated = cut_lineage(placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region"))
    members = cut_lineage(placed.join(repeated, "region").distinct())
    release(repeated)
    if pivots == "single":
        members = _often_met(members)
    regions = cut_lineage(members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = members.join(regions.where(F.col("n") <= FEW_SETS).select("region"), "region")
    many = cut_lineage(members.join(regions.where(F.col("n") > FEW_SETS).select("region"), "region"))
    pairs = _pairs_met(few, many)
    release(members, regions)
    if pivots == "single":
        many = _often_met(many)
    pivot = cut_lineage(many.groupBy("region").agg(F.min("set").alias("a")))
    stars = cut_lineage(many.join(pivot, "region").where("set <> a").select("a", F.col("set").alias("b")).distinct())
    release(many, pivot)
    involved = pairs.unionByName(stars).select(F.explode(F.array("a", "b")).alias("set")).distinct()
    known = cut_lineage(
        sets.where("set is not null and doc_id is not null").join(involved, "set").groupBy("set")
        .agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    )
    close = cut_lineage(_near(pairs, known, percent))
    release(pairs)
    turns = _measured(usable, known, close, size, lambda found: _links(found, percent))
    links = cut_lineage(reduce(DataFrame.unionByName, turns))
    release(close, *turns)
    if not stars.isEmpty():
        links = _links_in_cells(usable, known, stars, links, size, percent)
    return components(links).select(F.col("node").alias("set"), F.col("component").alias("group"))


def _links(measured: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pivots and members that are linked."""
    apart = (100 + percent) * (F.size("added") + F.size("gone"))
    return measured.where(apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _links_in_cells(usable: DataFrame, known: DataFrame, stars: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """``links`` and those of the cells of ``stars`` that tie their members together; frees ``known`` and ``stars``."""
    stars = _fewer_pivots(stars, known, percent)
    turns = _measured(usable, known, stars, size)
    measured = reduce(DataFrame.unionByName, turns)
    more, less = 100 - percent, 100 + percent
    links = links.unionByName(_links(measured, percent))
    centres = cut_lineage(_centres(measured, percent))
    about = [
        cut_lineage(
            turn.join(centres, "a", "left").select("a", "b", "n_b", "added", "gone", "centre_added", "centre_gone")
            .mapInArrow(_about_centre(percent), "a long, b long, n_b long, differ long, head array<long>")
        )
        for turn in turns
    ]
    moved = reduce(DataFrame.unionByName, about)
    release(centres)
    # members so close to the centre that they are linked whatever they share: a link of y to any
    # member means that y is linked to the one with the most room
    room = F.struct((more * F.col("n_b") - less * F.col("differ")).alias("room"), "b")
    best = cut_lineage(moved.groupBy("a").agg(F.max(room).alias("best")))
    close = moved.join(best, "a").where(
        (F.col("b") != F.col("best.b")) & (less * F.col("differ") <= more * F.col("n_b") + F.col("best.room"))
    )
    links = cut_lineage(links.unionByName(close.select(F.col("best.b").alias("u"), F.col("b").alias("v"))).distinct())
    release(best)
    groups = cut_lineage(components(links))
    member = groups.select(F.col("node").alias("b"), "component")
    grouped = moved.join(member, "b", "left").withColumn("group", F.coalesce("component", "b")).drop("component")
    mixed = cut_lineage(
        grouped.groupBy("a").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("a")
    )
    heads = grouped.join(mixed, "a").select("a", "b", "group", "n_b", "differ", "head").mapInArrow(
        _emit_heads, "key long, place int, cell long, set long, group long, n long, differ long"
    )
    shared = cut_lineage(
        heads.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    )
    meeting = cut_lineage(heads.join(shared, "key"))
    release(*about, mixed, shared)
    other = meeting.select("key", *[F.col(c).alias(f"__{c}") for c in meeting.columns if c != "key"])
    # if this is the first element they share, no more than the rest of the shorter one can follow
    left = F.least(F.col("differ") - F.col("place"), F.col("__differ") - F.col("__place"))
    enough = less * (F.col("differ") + F.col("__differ")) - more * (F.col("n") + F.col("__n")) <= 2 * less * left
    alike = percent * F.greatest("n", "__n") <= 100 * F.least("n", "__n")
    near = meeting.join(other, "key").where(
        (F.col("group") != F.col("__group")) & (F.col("set") < F.col("__set")) & enough & alike
    )
    pairs = cut_lineage(
        near.groupBy(F.col("set").alias("a"), F.col("__set").alias("b")).agg(F.min("cell").alias("cell"))
    )
    release(meeting)
    kept = cut_lineage(_near(pairs.select("a", "b"), known, percent))
    chosen = cut_lineage(pairs.join(kept, ["a", "b"]))
    release(known, pairs, kept)
    # only members of these pairs go to the last comparison
    paired = chosen.select(F.col("cell").alias("a"), F.explode(F.array("a", "b")).alias("b")).distinct()
    compared = cut_lineage(measured.join(paired, ["a", "b"], "left_semi"))
    release(*turns)
    found = cut_lineage(_linked(chosen, compared, percent))
    release(chosen, compared)
    return links.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v")))


def jaccard_groups(docs: DataFrame, *, size: int = 5, percent: int = 80, pivots: str = "single") -> DataFrame:
    """(doc_id, n_shingles, component_id): sets of ``size``-word shingles, linked from ``percent`` similarity on.

    ``component_id`` is the smallest doc_id that links reach. ``pivots`` is
    ``single`` or ``pieces``; both give the same groups.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = cut_lineage(
        docs.select("doc_id", "text").mapInArrow(_emit_sets(size), f"doc_id {kind}, n_shingles long, set long, sketch binary")
    )
    groups = set_groups(docs, sets, size=size, percent=percent, pivots=pivots)
    labelled = sets.drop("sketch").join(groups, "set", "left").withColumn("group", F.coalesce("group", "set"))
    grouped = labelled.where("group is not null and doc_id is not null")
    # an id that several texts share ties their groups together
    shared = grouped.groupBy("doc_id").agg(F.min("group").alias("u"), F.max("group").alias("v")).where("u < v")
    if not shared.isEmpty():
        pairs = grouped.join(shared.select("doc_id", "u"), "doc_id").select("u", F.col("group").alias("v"))
        ties = components(pairs).withColumnRenamed("node", "group")
        labelled = labelled.join(ties, "group", "left").withColumn("group", F.coalesce("component", "group")).drop("component")
        grouped = labelled.where("group is not null and doc_id is not null")
    first = cut_lineage(grouped.groupBy("group").agg(F.min("doc_id").alias("first")))
    return labelled.join(first, "group", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group; rows with a null id all stay.

    Of rows that repeat an id and a text one stays.
    """
    first = (
        jaccard_groups(docs, **options).where("doc_id = component_id or n_shingles = 0")
        .select(F.col("doc_id").alias("__first")).where("__first is not null").distinct()
    )
    whole = docs.where(F.col("doc_id").isNotNull())
    kept = whole.join(first, F.col("doc_id") == F.col("__first"), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.where(F.col("doc_id").isNull()))
