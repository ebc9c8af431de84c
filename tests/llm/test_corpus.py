"""Corpus operators against brute force on small tables with nulls, blanks, ties, repeats and odd columns."""

import hashlib
import itertools
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera import session
from tessera.llm import (
    components, decontaminate, jaccard, licences, logbilinear, mixing, quality, queries, revisits, sharding, spans, urlfilter, urls,
)
from tessera.llm.words import Words, per_slice

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, size string, word string, set string"


def words(text):
    return WORD.findall((text or "").encode())


def lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def corpus(seed=3, n=60, vocabulary=400):
    """Texts with exact and near copies, shared passages, nulls, blanks, one long text and odd spaces."""
    rd = random.Random(seed)
    vocab = ["".join(rd.choice("abcdéñ") for _ in range(rd.randint(1, 6))) for _ in range(vocabulary)]
    passage = [rd.choice(vocab) for _ in range(70)]
    texts = []
    for i in range(n):
        t = [rd.choice(vocab) for _ in range(rd.choice([0, 1, 2, 5, 40, 60, 120, 300]))]
        if i % 4 == 1:
            at = rd.randrange(len(t) + 1)
            t[at:at] = passage[rd.randrange(10) :]
        if i % 5 == 2 and texts:
            t = list(rd.choice(texts))
            for _ in range(rd.randrange(4)):
                if t:
                    t[rd.randrange(len(t))] = rd.choice(vocab)
        texts.append(t)
    out = [(i, "".join(w + rd.choice([" ", "\n", "\t", "  ", "\x0b"]) for w in t)) for i, t in enumerate(texts)]
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, " ".join(rd.choice(vocab) for _ in range(9000)))]
    out += [(n + 4, "x " * 200), (n + 5, "x " * 200), (n + 6, "ÄÖÜ one")]
    return out


def frame(spark, rows):
    full = [(i, t, None, None if (i or 0) % 7 == 0 else f"s{(i or 0) % 5}", None, "a", "b", "c", "d", "e") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, frame(spark, rows).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [(1, "a")]).limit(0)


def test_words_match_the_definition():
    rd = random.Random(1)
    texts = [None, "", " ", "é ü"] + ["".join(rd.choice("ab\x20\t\n\x0b\x0c\r\x1c\xa0é") for _ in range(rd.randrange(30))) for _ in range(200)]
    got = Words(pa.array(texts))
    names = {}
    for row, text in enumerate(texts):
        want = words(text)
        at = range(got.first[row], got.first[row + 1])
        assert [got.word(i) for i in at] == want
        for i, w in zip(at, want):
            names.setdefault(w, set()).add(int(got.hashes()[i]))
    assert all(len(v) == 1 for v in names.values())
    assert len({next(iter(v)) for v in names.values()}) == len(names)


def test_slices_cut_long_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 3_000_000, None, "b", "c" * 2_000_000, "d"])], ["text"])
    seen = []
    list(per_slice(lambda part, w: seen.append(part.num_rows))(iter([batch])))
    assert sum(seen) == 5 and len(seen) >= 2


# --- 1 -------------------------------------------------------------------------------------------

def test_revisits_take_the_latest_earlier_response(spark):
    rd = random.Random(5)
    rows = []
    for i in range(400):
        hot = rd.random() < 0.4
        url = rd.choice([None, "no scheme"]) if rd.random() < 0.05 else (
            "http://www.Hot.example.com/a/?b=2&a=1&utm_x=3#f" if hot else f"https://h{rd.randrange(20)}.example.org:443/p")
        kind = rd.choice(["response", "revisit", "revisit", "request"])
        headers = {k: str(rd.randrange(2)) for k in ("ETag", "Last-Modified", "Expires", "Server") if rd.random() < 0.6}
        rows.append((i, url, None if rd.random() < 0.03 else rd.randrange(50), kind, headers if rd.random() < 0.95 else None))
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "record_id long, url string, t long, kind string, headers map<string,string>")
    df = df.withColumn("captured_at", F.timestamp_seconds("t")).withColumn("cell", F.lit("clash")).withColumn("near", F.lit(1))
    got = Counter(
        (r.record_id, r.response_id, r.status, None if r.headers is None else tuple(sorted(r.headers.items())))
        for r in revisits.resolve_revisits(df, ranges=8).collect()
    )

    def key(url):
        if url is None or "://" not in url:
            return None
        return "hot.example.com/a?a=1&b=2" if "Hot" in url else url.split("://")[1].replace(":443", "")

    def order(r):
        return (r[2] is not None, r[2] or 0, r[0])

    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    want = Counter()
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [p for p in rows if p[3] == "response" and key(p[1]) is not None and key(p[1]) == key(r[1]) and order(p) < order(r)]
        if not before:
            want[(r[0], None, "no_response", None)] += 1
            continue
        best = max(before, key=order)
        old, new = low(best[4]), low(r[4])
        if "etag" in old and "etag" in new:
            status = "resolved" if old["etag"] == new["etag"] else "validator_mismatch"
        elif "last-modified" in old and "last-modified" in new:
            status = "resolved" if old["last-modified"] == new["last-modified"] else "validator_mismatch"
        else:
            status = "resolved_unchecked"
        merged = None if status == "validator_mismatch" else tuple(sorted((old | {k: v for k, v in new.items() if k in revisits.PERMITTED}).items()))
        want[(r[0], best[0], status, merged)] += 1
    assert got == want
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


# --- 2 -------------------------------------------------------------------------------------------

def groups_by_force(rows, size, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = [lower(x) for x in words(t)]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,percent,pivots", [(3, 90, "pieces"), (5, 80, "single")])
def test_jaccard_groups(spark, docs, none, size, percent, pivots):
    rows, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, size=size, percent=percent, pivots=pivots).collect()}
    want = groups_by_force(rows, size, percent)
    assert got == want and len({c for _, c in want.values()}) < len(rows)
    assert jaccard.jaccard_groups(none, size=size, percent=percent, pivots=pivots).count() == 0


def test_jaccard_chains_that_miss_the_first_pivot(spark):
    """A chain x0 - x1 - ... in which only neighbours are linked, all sharing most of their words."""
    rd = random.Random(2)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(25):
        rows.append((i, " ".join(base)))
        for _ in range(3):
            base[rd.randrange(200)] = f"n{i}-{rd.random()}"
    rd.shuffle(rows)
    df = frame(spark, rows)
    for size, percent, pivots in ((3, 90, "pieces"), (1, 95, "single"), (3, 85, "single")):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(df, size=size, percent=percent, pivots=pivots).collect()}
        assert got == {i: c for i, (_, c) in groups_by_force(rows, size, percent).items()}


def test_sets_that_never_meet_often_are_not_compared(spark, monkeypatch):
    """Every word is in three texts, so all texts are in many regions, but no two of them share more than a third."""
    words = {i: [] for i in range(8)}
    for n, three in enumerate(itertools.combinations(range(8), 3)):
        for i in three:
            words[i].append(f"w{n}")
    rows = [(i, " ".join(w)) for i, w in words.items()] + [(8, " ".join(words[0][1:])), (9, "none of these words")]
    asked = []

    def cut(df):
        table = session.cut_lineage(df)
        if "asks" in df.columns:
            asked.extend(r.doc_id for r in table.select("doc_id").collect())
        return table

    monkeypatch.setattr(jaccard, "cut_lineage", cut)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(frame(spark, rows), size=1, percent=80).collect()}
    assert got == {i: c for i, (_, c) in groups_by_force(rows, 1, 80).items()} and got[8] == 0
    assert set(asked) == {0, 8}


def test_many_sets_in_a_region_are_linked_by_cells(spark, monkeypatch):
    """Groups, with regions small and large, are those of brute force wherever the limit between them lies."""
    rd = random.Random(5)
    common, rows = [f"c{i}" for i in range(40)], []
    for i in range(48):
        text = common + [f"g{i % 3}-{j}" for j in range(50 * (i % 3))] + [f"o{i}-{j}" for j in range(rd.randint(0, 24))]
        rows.append((i, " ".join(text)))
    for most, size, percent, pivots in ((2, 1, 80, "single"), (5, 3, 90, "pieces")):
        monkeypatch.setattr(jaccard, "FEW_SETS", most)
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(frame(spark, rows), size=size, percent=percent, pivots=pivots).collect()}
        assert got == {i: c for i, (_, c) in groups_by_force(rows, size, percent).items()}


def test_jaccard_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = frame(spark, [(None, long), (3, long), (3, long), (5, "other words only here"), (9, long), (9, "other words only here")])
    got = Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_groups(df).collect())
    assert got == Counter({(None, None): 1, (3, 3): 3 - 1, (5, 3): 1, (9, 3): 2})
    kept = [r.doc_id for r in jaccard.keep_first(df).collect()]
    assert sorted(kept, key=str) == [3, None]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200, 202: 200}


# --- 3 -------------------------------------------------------------------------------------------

def edits_by_force(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_infix_distance():
    rd = random.Random(4)
    pairs = [tuple(bytes(rd.choice(b"abc") for _ in range(rd.randint(lo, 30))) for lo in (1, 0)) for _ in range(300)]
    pairs += [tuple(bytes(rd.choice(b"abcd") for _ in range(rd.randint(lo, 200))) for lo in (60, 0)) for _ in range(150)]
    for n in (63, 64, 65, 128, 129, 192):
        a = bytes(rd.choice(b"abcdefgh") for _ in range(n))
        pairs += [(a, b"x" + a + b"y"), (a, a[:-1]), (a, a[1:]), (a, a[:40] + b"zz" + a[41:]), (a, b"")] * 30
    want = [edits_by_force(a, b) for a, b in pairs]
    assert [decontaminate.infix_distance(a, b) for a, b in pairs] == want
    items, texts = (pa.array(x, pa.binary()) for x in zip(*pairs))
    assert decontaminate.infix_distances(items, texts).tolist() == want
    assert decontaminate.infix_distances(items.slice(290), texts.slice(290)).tolist() == want[290:]
    assert decontaminate.infix_distances(items[:0], texts[:0]).tolist() == []


def test_walk_keys_of_a_size_do_not_depend_on_other_sizes():
    folded = decontaminate.Folded(pa.array(["one two three four five six seven", None, "eight nine ten " * 9]))
    together = decontaminate.window_keys(folded.data, folded.starts, [48, 24, 12])
    for size, keys in together.items():
        alone = decontaminate.window_keys(folded.data, folded.starts, [size])[size]
        assert (alone == keys).all() and len(set(keys[0].tolist())) == keys.shape[1]


def test_every_item_of_a_window_or_more_has_walk_keys():
    rd = random.Random(5)
    texts = [" ".join("".join(rd.choice("abcdef") for _ in range(rd.randint(2, 7))) for _ in range(n)) for n in range(4, 60)]
    folded = decontaminate.Folded(pa.array(texts))
    walked = {r for _, index in decontaminate.item_windows(folded) for r in folded.row[index].tolist()}
    assert walked == set(range(len(texts)))


def test_leaks_are_found_and_clean_texts_left(spark, docs, none):
    rd = random.Random(6)
    rows, _ = docs
    letters = "abcdefgh"
    items = [(i, " ".join("".join(rd.choice(letters) for _ in range(rd.randint(2, 7))) for _ in range(rd.randint(6, 40)))) for i in range(40)]
    items += [(100, None), (101, " .. "), (102, items[0][1])]
    planted, plain = [], rows[:60]
    for n in range(160):
        k, text = items[n % 40]
        s = list(text.upper() if n % 3 == 0 else text)
        for _ in range(int(len(s) * 0.06) if n >= 80 else 0):
            p = rd.randrange(len(s))
            s[p] = rd.choice(letters + " ")
        around = plain[n % len(plain)][1] or ""
        planted.append((1000 + n, around + " " + "".join(s) + ". " + around, k))
    df = frame(spark, plain + [(i, t) for i, t, _ in planted] + [(None, items[3][1]), (None, items[3][1])])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("clash"))
    got = decontaminate.find_leaks(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert not [p for p in pairs if p[0] is not None and p[0] < 1000]
    assert all((i, k) in pairs for i, _, k in planted[:80]), "exact copies"
    assert sum((i, k) in pairs for i, _, k in planted[80:]) >= 0.9 * 80, "edited copies"
    assert (1000, 102) in pairs and (None, 3) in pairs and not {k for _, k in pairs} & {100, 101}
    kept = decontaminate.drop_leaks(df, bench)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 1000) == sorted(i for i, _ in plain)
    assert kept.columns == df.columns and not kept.where("doc_id is null").count()
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_short_items_are_found_at_any_place_with_any_edits(spark):
    rd = random.Random(8)
    word = lambda: "".join(rd.choice("abcdefghiklmnoprstu") for _ in range(rd.randint(3, 8)))
    items = [(n, " ".join(word() for _ in range(1 + n % 14))) for n in range(140)]
    planted = []
    for n, (k, text) in enumerate(items * 2):
        s, edited = list(text), n >= len(items)
        for _ in range(int(len(s) * 0.1) if edited else 0):
            p, kind = rd.randrange(len(s)), rd.randrange(3)
            s[p : p + (kind > 0)] = rd.choice("xyz") if kind < 2 else ""
        before = " ".join(word() for _ in range(n % 5))
        after = " ".join(word() for _ in range(n % 3 * 4))
        planted.append((1000 + n, f"{before} {''.join(s)} {after}".strip(), k))
    planted.append((5000, "pre" + items[0][1] + "s", None))
    df = frame(spark, [(i, t) for i, t, _ in planted])
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, text, _ in planted:
        for k, item in items:
            edits = len(item) // 10
            if not edits:
                if f" {item} " in f" {text} ":
                    want[i, k] = 0
            elif len(item) < decontaminate.PIECED and (d := decontaminate.infix_distance(item.encode(), text.encode())) <= edits:
                want[i, k] = d
    assert {p: d for p, d in got.items() if len(items[p[1]][1]) < decontaminate.PIECED} == want
    assert all((i, k) in got for i, _, k in planted[: len(items)])
    assert (5000, 0) not in got


def test_more_changes_lower_the_expected_recall():
    chances = [decontaminate.expected_recall(h, 3) for h in (0.0, 0.1, 0.2, 0.4)]
    assert chances[0] == 1 and chances == sorted(chances, reverse=True) and chances[1] > 0.99


# --- 4 -------------------------------------------------------------------------------------------

def test_licence_paragraphs(spark, docs, none):
    rows, _ = docs
    families = defaultdict(list)
    for family, text in licences.TEMPLATES:
        families[family].append(text)
    lines = [(500 + n, f"{rows[5][1] or 'a'}\n\n{t}\nlast words", f) for n, (f, ts) in enumerate(families.items()) for t in ts[:2]]
    df = frame(spark, rows + [(i, t) for i, t, _ in lines] + [(None, "Released under the MIT License."), (7, "Released under the MIT License.")])
    model = licences.fit(df)
    found = licences.classify(df, model).collect()
    # held-out wording: the rows' own lines are only weakly labelled, so families must be met on nearly all
    right = {(i, f) for i, _, f in lines} & {(r.doc_id, r.family) for r in found}
    assert len(right) >= 0.9 * len({(i, f) for i, _, f in lines})
    assert all(r.probability >= licences.LEAST_PROBABILITY for r in found)
    clean = {i for i, _ in rows} - {7}
    assert not [r for r in found if r.doc_id in clean]
    assert {r.doc_id for r in found if r.family == "mit" and r.confirmed} >= {None, 7}
    assert licences.classify(none, model).count() == 0


def test_wrapped_notices_are_put_together(spark, docs):
    rows, _ = docs
    long = [(f, t) for f, t in licences.TEMPLATES if len(t) > 120]
    made = []
    for n, (family, text) in enumerate(long):
        for m, (width, mark) in enumerate(((72, ""), (72, "# "), (40, " * "), (20, "// "))):
            lines = [mark + x for x in textwrap.wrap(text, width)]
            before, after = (["xyzzy qux"], ["plugh"]) if m % 2 else (["", mark], [mark, ""])
            made.append((900 + 10 * n + m, "\n".join(before + lines + after), family, len(before), len(lines)))
    df = frame(spark, rows + [x[:2] for x in made])
    found = licences.classify(df, licences.fit(df)).where("doc_id >= 900").collect()
    confirmed = {(r.doc_id, r.family, r.paragraph, r.lines) for r in found if r.confirmed and r.similarity == 1}
    assert {(i, *rest) for i, _, *rest in made} <= confirmed
    assert len(found) == len(made)


# --- 5 -------------------------------------------------------------------------------------------

def spans_by_force(rows, span=50):
    first, split = {}, [(i, words(t)) for i, t in rows]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - span + 1):
                k = tuple(w[s : s + span])
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            if i is not None and first[tuple(w[s : s + span])] < i:
                gone[s : s + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeated_spans(spark, docs, none):
    rows, df = docs
    rows = rows + [rows[2], (None, rows[9][1]), (4, rows[13][1]), (900, rows[13][1]), (901, "y " * 300), (902, "y " * 120 + "z " + "y " * 60)]
    got = Counter(tuple(r) for r in spans.remove_repeated_spans(frame(spark, rows).repartition(3)).collect())
    want = spans_by_force(rows)
    assert got == want and sum(k[2] > 0 for k in want) > 5
    assert spans.remove_repeated_spans(none).count() == 0


# --- 6 -------------------------------------------------------------------------------------------

def test_quality_measures(spark, docs, none):
    rows, _ = docs
    extra = [(300, "a b\na b\n \n\na b\nc"), (301, "#x *y $% & | < >\n#x"), (302, "p q r s t p q r s t u v")]
    df = frame(spark, rows + extra + [(None, "p q")])
    ratio = quality.fit_ratio(df, spark.createDataFrame([(i,) for i in range(20)], "doc_id long"))
    assert quality.fit_ratio(df, spark.createDataFrame([], "doc_id long")).weights.any() == False  # noqa: E712
    got = {r.doc_id: r for r in quality.judge(df, ratio).collect()}
    for i, text in rows + extra:
        r, w, t = got[i], words(text), text or ""
        lines = [line for line in t.encode().split(b"\n") if words(line.decode())]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert r.kept == (not r.base_failed and r.score >= ratio.threshold)
        raw = t.encode()
        codes = [((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 0x9E3779B1 % (1 << 32) >> 7) % quality.BUCKETS for k in range(len(raw) - 2)]
        assert r.score == pytest.approx(np.mean([ratio.weights[c] for c in codes]) if codes else 0.0)
    kept = quality.keep_good(df, ratio)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(none, ratio).count() == 0


def test_quality_tells_labelled_documents_apart(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    verdicts = queries.QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    share = {r.quality: r.kept for r in verdicts.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert df.count() and share[1] > 0.95 and share[0] < 0.15


# --- 7 -------------------------------------------------------------------------------------------

def check_shards(rows, shards, slack):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total = sum(r.size for r in rows)
    assert set(by) <= set(range(shards))
    assert all(abs(sum(r.size for r in part) - total / shards) <= slack for part in by.values())


def test_shards_are_level_and_equal_texts_lie_together(spark, none):
    rd = random.Random(8)
    rows = [(i, "".join(rd.choice("abc ") for _ in range(rd.randint(0, 400)))) for i in range(1500)] + [(i, None) for i in range(5)]
    rows += [(2000 + i, "the same text again and again " * 6) for i in range(700)] + [rows[0]] * 3
    df = frame(spark, rows)
    out = sharding.range_shards(df, ranges_per_shard=32)
    assert set(out.columns) == set(df.columns) | {"slot"} and out.count() == len(rows)
    got = out.withColumn("size", sharding.record_size()).collect()
    share = sum(r.size for r in got) / 8
    check_shards(got, 8, 0.1 * share)
    near = defaultdict(set)
    for r in got:
        near[r.text].add(r.shard)
    assert all(max(s) - min(s) == len(s) - 1 for s in near.values())
    assert all(len(s) == 1 for t, s in near.items() if t is None or not t.startswith("the same"))
    assert sharding.range_shards(none).count() == 0


# --- 8 -------------------------------------------------------------------------------------------

def test_url_parts_and_verdicts(spark):
    given = [
        (1, None), (2, "no scheme.net/es/"), (3, "http://WWW.Example.COM/en/x?y#z"), (4, "ftp://m.example.com/en/"), (5, "http://a.com"),
        (6, "http://a.net/fr/?q"), (7, "http://net/es/1"), (8, "http://x.org?a/b"), (9, "https://casino.org/en/"), (9, "https://casino.org/en/"),
        (10, "x://y://z.net/es/"), (11, "http://casinonet/es/"),
    ]
    pages = spark.createDataFrame(given, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    listed = spark.createDataFrame([("http://www.casino.org/en",), (None,), ("https://casino.org/en/#x",)], "url string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(pages, listed, queries.RULES).collect()}
    assert got == {
        1: ("", "", None, False, "allow"), 2: ("", "", None, False, "allow"),
        3: ("www.example.com", "/en/x", "www.example.com/en/", False, "allow"),
        4: ("m.example.com", "/en/", "example.com/en/", False, "block"), 5: ("a.com", "", None, False, "allow"),
        6: ("a.net", "/fr/", "net/fr/", False, "block"), 7: ("net", "/es/1", "net/es/", False, "block"),
        8: ("x.org", "", None, False, "allow"), 9: ("casino.org", "/en/", None, True, "block"),
        10: ("y:", "//z.net/es/", None, False, "allow"), 11: ("casinonet", "/es/", None, False, "allow"),
    }
    assert urlfilter.judge_urls(pages, listed, queries.RULES).count() == len(given)
    assert urlfilter.judge_urls(pages, listed.limit(0), queries.RULES).where("listed").count() == 0
    assert urlfilter.judge_urls(pages.limit(0), listed, queries.RULES).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("url"))
    asked = spark.range(0, 20000, 1).select(F.concat(F.lit("h/"), "id").alias("c"))
    for limit in (urlfilter.BROADCAST_BYTES, 0):
        kept, urlfilter.BROADCAST_BYTES = urlfilter.BROADCAST_BYTES, limit
        try:
            passed = {r.c for r in urlfilter.possible_hits(asked, "c", listed).collect()}
        finally:
            urlfilter.BROADCAST_BYTES = kept
        assert passed >= {f"h/{i}" for i in range(3000)} and len(passed) < 3000 + 0.1 * 17000


def test_canonical_urls(spark):
    given = ["HTTP://WWW.A.com:80/b//?z=1&utm_source=x&a=2&&ref#f", "https://a.com/b", "https://a.com/b?ref=1", "a.com/b", "http://"]
    df = spark.createDataFrame([(u,) for u in given], "url string")
    assert [r[0] for r in df.select(urls.canonical(F.col("url"))).collect()] == ["a.com/b?a=2&z=1", "a.com/b", "a.com/b", None, ""]


# --- 9 -------------------------------------------------------------------------------------------

def test_scores(spark, docs, none):
    rows, _ = docs
    rows = rows + [(None, "x x"), rows[3]]
    got = logbilinear.score_texts(frame(spark, rows), vocabulary=50, local=100).collect()
    tokens = [(i, [lower(w) for w in words(t)] + [None]) for i, t in rows]
    counts = Counter()
    for i, t in tokens:
        if not logbilinear.fold_of(i):
            counts.update(t)
    total = sum(counts.values())
    mass = total + 0.1 * (len(counts) + 1)
    want = Counter()
    for i, t in tokens:
        base = sum(np.log10((counts[w] + 0.1) / mass) for w in t)
        want[(i, logbilinear.fold_of(i), len(t), sum(counts[w] > 0 for w in t), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert logbilinear.score_texts(none).count() == 0


def test_model_is_normalised_and_beats_the_base_on_held_out_texts(spark):
    got = queries.QUERIES["op9_log_bilinear"](spark, "/root/testdata/sf0.01").where("held_out")
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base
    share = np.random.default_rng(0).random(30)
    model = logbilinear.Model.start(30, share / share.sum())
    table = logbilinear.normalisers(got, model)
    odds = model.predicted(np.array([3]), np.array([30]))[0] @ model.words.T + model.bias
    assert np.exp(odds - table[3, 30]).sum() == pytest.approx(1, abs=1e-4)


# --- 10 ------------------------------------------------------------------------------------------

def targets_by_force(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix(spark, none):
    rd = random.Random(9)
    big = {"a": 20, "b": 500, "Z": 300, "é": 5, None: 60, "empty": 3}
    rows = [(n * 1000 + i, None if s == "empty" else "w " * rd.randint(0, 30), s) for n, (s, k) in enumerate(big.items()) for i in range(k)]
    rows += [rows[0], (None, "q q", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("copies", F.lit(0))
    plan = mixing.mix(df)
    got = plan.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_force(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and r.copies <= 3 and len(r.shards) == r.copies
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    words_of = Counter()
    for r in got:
        for s in r.shards:
            words_of[s] += r.size
    mean = sum(words_of.values()) / mixing.SHARDS
    assert all(abs(words_of[s] - mean) < 0.5 * mean for s in range(mixing.SHARDS))
    mixed = mixing.mixed_rows(df)
    assert mixed.schema == df.schema and mixed.count() == sum(r.copies for r in got)
    assert {(r.size, r.copies) for r in mixed.collect()} == {("x", 0)}
    copies = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    assert copies == Counter((r.doc_id, r.text, r.source) for r in got for _ in range(r.copies))
    twins = spark.createDataFrame([(i % 3, f"{i} word", "a") for i in range(40)] + [(99, "w " * 900, "b")], "doc_id long, text string, source string")
    again = [sorted(map(str, mixing.mixed_rows(twins.repartition(n)).collect())) for n in (1, 7)]
    assert again[0] == again[1]
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    blocks = spark.createDataFrame([(c, b) for c, n in ((1, 37), (2, 5), (3, 80)) for b in range(n)], "code int, block long")
    got = mixing.split_blocks(blocks, 8).collect()
    assert len(got) == len({(r.code, r.block) for r in got}) == 122
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 3


# --- all -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    place = [columns.index(c) for c in df.columns]
    want = Counter(tuple(r[i] for i in place) for r in cursor.fetchall())
    assert Counter(map(tuple, df.collect())) == want and want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "decontamination", "mix_sources", "shard"]
    now = docs
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, FOLDER).cache()
        texts = {r.doc_id: r.text for r in now.collect()}
        before, after = ids(now), ids(out)
        if name != "shard":
            assert out.columns == docs.columns
        if name == "quality_rules":
            verdict = queries.QUERIES["op6_quality_rules"](spark, FOLDER)
            assert after == Counter(r.doc_id for r in verdict.where("kept").collect())
        if name == "jaccard_join":
            found = groups_by_force(list(texts.items()), 5, 80)
            assert after == Counter(i for i, (_, c) in found.items() if i == c) and len(after) < len(before)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert not [i for i in after if any(t in texts[i] for t in items)]
            assert len(before) - len(after) <= 3 + sum(any(t in x for t in items) for x in texts.values())
        if name == "mix_sources":
            assert set(after) <= set(before) and max(after.values()) <= 3
            assert sum(len(words(texts[i])) * n for i, n in after.items()) == pytest.approx(sum(len(words(t)) for t in texts.values()), rel=0.2)
        if name == "shard":
            assert after == before
            rows = out.withColumn("size", sharding.record_size()).collect()
            check_shards(rows, 8, max(r.size for r in rows) * 1.5)
        now = out.drop("shard", "slot") if name == "shard" else out
    assert ids(corpus_pipeline.run(spark, FOLDER)) == after
