"""A log-bilinear language model trained in numpy with noise-contrastive estimation.

Words are lower-cased (A-Z); a text's tokens are its words and one end token.
The model's vocabulary is the ``VOCABULARY`` most frequent tokens; all others
share one entry. The two tokens before a word (text starts included) predict a
vector by a sum of their own vectors, weighted per dimension and position; its
inner products with the word vectors plus biases are log-odds against a shared
noise sample while training (noise-contrastive estimation, one pass over all
training tokens). Every task trains from the same start on its own rows; the
results are averaged by tokens.

Scores are normalised exactly: the sum over the vocabulary depends on the two
context entries only, so batched matrix products fill a table of it for all
pairs of entries. The shared entry's probability is spread over its words like
the base model's, and the whole is mixed with the base (unigram) model, so
that all words, also unseen ones, have a probability and the sum is one.

Counting is a grouped sum of all training tokens. What reaches the driver is
bounded by the two vocabulary sizes. Tokens outside the ``LOCAL`` most frequent
ones get their counts by a join, pre-aggregated per document.

Words are named by 64-bit hashes. Null text is empty: one end token. A null
doc_id counts as the text ``null`` for the fold. Rows are scored one by one, so
repeated ids and rows are fine. Columns besides id and text are unread.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, list_column, per_slice, signed
from tessera.session import cut_lineage

VOCABULARY = 1023
LOCAL = 1 << 17
DIMENSIONS = 16
NOISE = 48
BATCH = 4096
RATE = 0.15
SMOOTHING = 0.1
# weight of the base model in the mixture
BASE_SHARE = 0.1
SEED = 5
END = np.int64(np.uint64(0x5EED0F7E87E0D000).view(np.int64))


def held_out(doc_id: str = "doc_id") -> Column:
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.pmod(F.crc32(name.cast("binary")), F.lit(10)) == 0


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by an end token; the first token of each text."""
    first = words.first[:-1] + np.arange(len(words.counts))
    out = np.full(len(words) + len(words.counts), END, np.int64)
    spot = np.ones(len(out), bool)
    spot[words.first[1:] + np.arange(len(words.counts))] = False
    out[spot] = signed(words.hashes(lower=True))
    return out, np.append(first, len(out))


def _count_tokens(batches):
    def count(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        token, n = np.unique(_tokens(words)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

    return per_slice(count)(batches)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) over all of ``docs``, whole texts."""
    return docs.select("text").mapInArrow(_count_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """The most frequent tokens in the order of their hashes, with counts and model entries."""

    token: np.ndarray
    count: np.ndarray
    entry: np.ndarray  # entry of the model; VOCABULARY-th and beyond share the last one
    entries: int

    def find(self, token: np.ndarray) -> np.ndarray:
        """Place of each token; -1 if it is not among them."""
        if not len(self.token):
            return np.full(len(token), -1)
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        return np.where(self.token[at] == token, at, -1)


def frequent_tokens(counts: DataFrame, local: int = LOCAL, vocabulary: int = VOCABULARY) -> Frequent:
    rows = counts.orderBy(F.desc("n"), "token").limit(local).toArrow()
    token, count = rows.column("token").to_numpy(), rows.column("n").to_numpy()
    entry = np.minimum(np.arange(len(token)), vocabulary)
    order = np.argsort(token)
    return Frequent(token[order], count[order], entry[order], vocabulary + 1)


@dataclass
class Model:
    """Vectors of contexts (``entries`` + 1 rows, the last for a text's start) and of words, and biases."""

    context: np.ndarray
    words: np.ndarray
    bias: np.ndarray
    weight: np.ndarray  # per context position and dimension

    @staticmethod
    def start(entries: int, share: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        draw = np.random.default_rng(SEED)
        return Model(
            draw.normal(0, 0.1, (entries + 1, dimensions)).astype(np.float32),
            draw.normal(0, 0.1, (entries, dimensions)).astype(np.float32),
            np.log(np.maximum(share, 1e-9)).astype(np.float32),
            np.ones((2, dimensions), np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.words, self.bias, self.weight]

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Predicted vectors for the entries one and two tokens back."""
        return self.context[one] * self.weight[0] + self.context[two] * self.weight[1]


class Steps:
    """Adagrad: every number moves by its slope over the root of its slopes' squares so far."""

    def __init__(self, model: Model, rate: float | None = None):
        self.rate, self.squares = rate or RATE, [np.full_like(x, 1e-6) for x in model.arrays()]

    def rows(self, table: np.ndarray, which: int, rows: np.ndarray, slope: np.ndarray) -> None:
        """Move the given rows, which may repeat, by the sums of their slopes."""
        if len(table) <= 1 << 16:
            rows = rows.astype(np.uint16)  # sorted by digits
        order = np.argsort(rows, kind="stable")
        start = np.flatnonzero(np.diff(rows[order].astype(np.int64), prepend=-1))
        at, total = rows[order][start], np.add.reduceat(slope[order], start, axis=0)
        squares = self.squares[which]
        squares[at] += total * total
        table[at] += self.rate * total / np.sqrt(squares[at])


def train_batch(model: Model, steps: Steps, one, two, word, noise, log_noise) -> None:
    """One step of noise-contrastive estimation against a noise sample that the batch shares."""
    k, n = len(noise), len(word)
    vector = model.predicted(one, two)
    own = np.einsum("ij,ij->i", vector, model.words[word]) + model.bias[word] - np.log(k) - log_noise[word]
    other = vector @ model.words[noise].T + model.bias[noise] - np.log(k) - log_noise[noise]
    up = 1 / (1 + np.exp(np.clip(own, -30, 30)))
    down = -1 / (1 + np.exp(-np.clip(other, -30, 30)))
    pull = up[:, None] * model.words[word] + down @ model.words[noise]
    before = [pull * model.context[one], pull * model.context[two]]
    places = np.concatenate([word, noise])
    slope = np.concatenate([up[:, None] * vector, down.T @ vector]).astype(np.float32) / n
    bias_slope = np.concatenate([up, down.sum(0)]).astype(np.float32) / n
    steps.rows(
        model.context, 0, np.concatenate([one, two]), np.concatenate([pull * model.weight[0], pull * model.weight[1]]) / n
    )
    steps.rows(model.words, 1, places, slope)
    steps.rows(model.bias, 2, places, bias_slope)
    steps.rows(model.weight, 3, np.array([0, 1]), np.stack([x.mean(0) for x in before]))


def _entries(token: np.ndarray, first: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place among the frequent tokens, entry, and the entries one and two tokens back."""
    place = frequent.find(token)
    shared = frequent.entries - 1
    entry = np.where(place >= 0, frequent.entry[place] if len(frequent.entry) else shared, shared)
    one, two = np.roll(entry, 1), np.roll(entry, 2)
    begin = first[:-1]
    one[begin] = two[begin] = frequent.entries
    after = begin + 1
    after = after[after < first[1:]]
    two[after] = frequent.entries
    return place, entry, one, two


def _train(frequent: Frequent, share: np.ndarray, model_of):
    noise_share = share**0.75
    noise_share /= noise_share.sum()
    log_noise = np.log(noise_share).astype(np.float32)

    def run(batches):
        model, seen = model_of(), 0
        steps = Steps(model)
        draw = np.random.default_rng(SEED)

        def step(part: pa.RecordBatch, words: Words) -> None:
            nonlocal seen
            token, first = _tokens(words)
            _, entry, one, two = _entries(token, first, frequent)
            for a in range(0, len(token), BATCH):
                b = slice(a, a + BATCH)
                noise = draw.choice(len(share), NOISE, p=noise_share)
                train_batch(model, steps, one[b], two[b], entry[b], noise, log_noise)
                seen += len(entry[b])

        for _ in per_slice(step)(batches):
            pass
        values = np.concatenate([x.ravel() for x in model.arrays()]).astype(np.float64) * seen
        rows = np.arange(-1, len(values), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.append(float(seen), values))], ["at", "value"])

    return run


def train(docs: DataFrame, frequent: Frequent, share: np.ndarray) -> Model:
    """One pass over all of ``docs``; the tasks' models are averaged by their number of tokens."""
    start = Model.start(frequent.entries, share)
    parts = docs.select("text").mapInArrow(
        _train(frequent, share, lambda: Model.start(frequent.entries, share)), "at long, value double"
    )
    total = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    order = np.argsort(total.column("at").to_numpy())
    values = total.column("value").to_numpy()[order]
    if not len(values) or values[0] == 0:
        return start
    values, at, out = values[1:] / values[0], 0, []
    for array in start.arrays():
        out.append(values[at : at + array.size].reshape(array.shape).astype(np.float32))
        at += array.size
    return Model(*out)


def _normalisers(model: Model):
    def run(batches):
        size = len(model.context)
        for batch in batches:
            for one in batch.column("id").to_numpy():
                vector = model.predicted(np.full(size, one), np.arange(size))
                odds = vector @ model.words.T + model.bias
                top = odds.max(1)
                total = top + np.log(np.exp(odds - top[:, None]).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one]), list_column(total.astype(np.float32), [size], pa.float32())], ["one", "total"]
                )

    return run


def normalisers(docs: DataFrame, model: Model) -> np.ndarray:
    """Log of the sum over the vocabulary for every pair of context entries: a table of (entries + 1)^2."""
    size = len(model.context)
    spark = docs.sparkSession
    ids = spark.range(0, size, 1, min(size, max(1, spark.sparkContext.defaultParallelism) * 4))
    rows = ids.mapInArrow(_normalisers(model), "one long, total array<float>").toArrow()
    table = np.zeros((size, size), np.float32)
    table[rows.column("one").to_numpy()] = rows.column("total").combine_chunks().values.to_numpy().reshape(size, size)
    return table


def _score(frequent: Frequent, model: Model, table: np.ndarray, mass: float, shared_mass: float):
    """Per document: sums over frequent tokens, and what is left to add for each rare token.

    A token's probability is its smoothed count times a factor of its context:
    BASE_SHARE / mass, plus the model's probability of its entry over the
    entry's smoothed count.
    """
    smoothed = frequent.count + SMOOTHING
    own_mass = np.where(frequent.entry < frequent.entries - 1, smoothed, shared_mass)

    def rows(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        token, first = _tokens(words)
        place, entry, one, two = _entries(token, first, frequent)
        chance = np.zeros(len(token))
        for a in range(0, len(token), 1 << 16):
            b = slice(a, a + (1 << 16))
            odds = np.einsum("ij,ij->i", model.predicted(one[b], two[b]), model.words[entry[b]]) + model.bias[entry[b]]
            chance[b] = np.exp(odds - table[one[b], two[b]])
        near = place >= 0
        weight = np.where(near, own_mass[place] if len(own_mass) else shared_mass, shared_mass)
        factor = np.log10(BASE_SHARE / mass + (1 - BASE_SHARE) * chance / weight)
        known = np.where(near, np.log10(smoothed)[place] if len(smoothed) else 0.0, 0.0)

        def sums(x):
            total = np.concatenate([[0], np.cumsum(x)])
            return total[first[1:]] - total[first[:-1]]

        rare, rare_first = token[~near], np.searchsorted(np.flatnonzero(~near), first)
        counts = sums(np.ones(len(token), np.int64))
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), part.column("row"), pa.array(counts), pa.array(sums(near.astype(np.int64))),
                pa.array(sums(known)), pa.array(sums(factor)),
                list_column(rare, np.diff(rare_first), pa.int64()),
            ],
            ["doc_id", "row", "n_tokens", "n_near", "near", "factor", "rare"],
        )

    return per_slice(rows)


def score_texts(docs: DataFrame, *, vocabulary: int = VOCABULARY, local: int = LOCAL) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    training = docs.where(~held_out())
    counts = cut_lineage(count_tokens(training))
    train_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_tokens(counts, local, vocabulary)
    mass = train_tokens + SMOOTHING * (distinct + 1)
    inside = frequent.entry < vocabulary
    shared_mass = mass - float((frequent.count[inside] + SMOOTHING).sum())
    share = np.full(vocabulary + 1, SMOOTHING)
    share[frequent.entry[inside]] = frequent.count[inside] + SMOOTHING
    share[vocabulary] = shared_mass
    share /= share.sum()
    model = train(training, frequent, share)
    table = normalisers(docs, model)
    rows = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"))
    scored = cut_lineage(
        rows.mapInArrow(
            _score(frequent, model, table, mass, shared_mass),
            f"doc_id {kind}, row long, n_tokens long, n_near long, near double, factor double, rare array<long>",
        )
    )
    # rows with the same id and text have the same rare tokens: counted once, joined to each
    rare = (
        scored.select("row", "rare").dropDuplicates(["row"])
        .select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    )
    added = (
        rare.join(counts, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("far"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_far"),
        )
    )
    tokens = F.col("near") + F.coalesce("far", F.lit(0.0))
    return scored.drop("rare").join(added, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens",
        (F.col("n_near") + F.coalesce("n_far", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (tokens - F.col("n_tokens") * float(np.log10(mass))).alias("base_score"),
        (tokens + F.col("factor")).alias("score"),
    )


def fold_of(doc_id) -> bool:
    """``held_out`` for one id, for tests."""
    return zlib.crc32(str(doc_id if doc_id is not None else "null").encode()) % 10 == 0
