"""Packing, spelling variants and phrases against plain versions of their definitions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, phrases, variants
from tessera.llm.words import configure_for_texts

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, start long, word string, n long, row long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = "the of on Then it's naïve stone storm élan ACHE reading treading reader 12,5 end; x\n\n a  b".split(" ")
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 120))), r.choice(["en", "fr", None]), r.choice("abc")) for i in range(200)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (7, rows[7][1], "en", "b"), (7, "other", None, "b"), (None, "no id at all", "en", "c")]
    rows += [(202, "storm reading. " * 9000, "en", "a"), (203, "storm reading stone " * 4000, "fr", "b"), (204, "\n\n\t  ", "de", "c")]
    return [(*row, 5, "x", 1, 2) for row in rows]


@pytest.fixture(scope="module")
def docs(spark, texts):
    configure_for_texts(spark)
    return spark.createDataFrame(texts, SCHEMA).repartition(5)


@lru_cache(maxsize=1)
def _tokenizer():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _tokens(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_tokenizer():
    r = random.Random(1)
    signs = list(" \n\t\r\x85\x1c'’.,;:!?<|>#$-_/0123abgstvESTéèÀß×÷漢😀 　") + ["'s", "'t", "<|endoftext|>", " the", "  ", "\n\n"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 50))) for _ in range(3000)]
    with open(BPE, encoding="utf-8") as f:
        ids, counts = packing.Encoder(f.read()).encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == _tokens(text)[:-1], text
        at += n


def _checked(texts, pieces, window):
    """Every id in one piece, gapless sequences, no padding; gives sequence -> source -> tokens."""
    by_doc, by_sequence, mixture = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        by_doc[p["doc_id"]].append((p["start"], p["doc_tokens"], ids))
        by_sequence[p["sequence_id"]].append((p["offset"], len(ids)))
        mixture[p["sequence_id"]][p["source"]] += len(ids)
    want = defaultdict(list)
    for row in texts:
        want[row[0]].append(_tokens(row[1]))
    for doc, lists in want.items():
        if len(lists) == 1:  # pieces of rows of one id cannot be told apart
            whole, at = [], 0
            for start, n, ids in sorted(by_doc[doc]):
                assert (start, n) == (at, len(lists[0]))
                whole, at = whole + ids, at + len(ids)
            assert whole == lists[0]
        assert sorted(i for _, _, ids in by_doc[doc] for i in ids) == sorted(i for one in lists for i in one)
    for number in range(len(by_sequence)):
        at = 0
        for offset, n in sorted(by_sequence[number]):
            assert offset == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)
    return mixture


def test_pack_by_the_corpus_shares(texts, docs):
    pieces = packing.pack(docs, BPE).collect()
    mixture = _checked(texts, pieces, 1024)
    total = Counter()
    for found in mixture.values():
        total.update(found)
    size = sum(total.values())
    full = [m for m in mixture.values() if sum(m.values()) == 1024]
    # a queue is served 32 tokens at a time, and a round's tokens may begin anywhere in a sequence
    slack = 32 * (len(total) + 1)
    assert full and all(abs(m[s] - 1024 * total[s] / size) <= slack for m in full for s in total)


def test_pack_by_given_weights(texts, docs):
    pieces = packing.pack(docs, BPE, weights={"a": 1, "b": 3}, rest=0.5, window=256, least=8).collect()
    mixture = _checked(texts, pieces, 256)
    # while no queue is dry, b has three times what a has
    first = [mixture[i] for i in range(20)]
    assert all(2.0 < m["b"] / m["a"] < 4.5 for m in first)
    whole = packing.sequences_of(packing.pack(docs, BPE, window=256)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and r["segments"][0]["offset"] == 0 for r in whole)


def test_schedule_follows_the_rounds():
    """Credits and service equal those of a loop that carries deficits from round to round."""
    sizes, weights = [5000, 900, 12000, 40], [3.0, 1.0, 2.0, 1.0]
    schedule = packing.Schedule(sizes, weights, 100, 8)
    rounds = np.arange(schedule.rounds + 1)
    served, credit = schedule.served(rounds), schedule.credit(rounds)
    assert (np.diff(served, axis=0) >= 0).all() and (served[0] == 0).all() and served[-1].tolist() == sizes
    assert ((credit - served >= 0) & (credit - served < 8))[:-1].all()
    have, left = np.zeros(4), np.array(sizes, float)
    for r in range(schedule.rounds - 1):
        room = min(100.0, left.sum())
        while room > 1e-9:
            live = left > 1e-9
            share = np.where(live, np.array(weights), 0) / np.array(weights)[live].sum()
            step = min(room, *(left[live] / share[live]))
            have, left, room = have + step * share, left - step * share, room - step
        assert np.allclose(credit[r + 1], have, atol=1e-6)


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), BPE).count() == 0


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    near = {w: [x for x in counts if x != w and _near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def _word_rows(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("cell, visits", [(10_000, 25_000), (60, 400)])
def test_spelling_groups(spark, monkeypatch, cell, visits):
    """Also with tasks of few members, so that nodes are split and dealt to a grid."""
    monkeypatch.setattr(variants, "CELL", cell)
    monkeypatch.setattr(variants, "VISITS", visits)
    r = random.Random(3)
    counts = {}
    for _ in range(300):
        w = "".join(r.choice("aeéthÿ") for _ in range(r.randrange(5, 8)))
        counts[w] = r.choice([3, 4, 7, 15, 40, 200])
    counts |= {"a" * 400: 9, "a" * 401: 30, "a" * 399 + "b": 4, "b" * 33: 3, "b" * 34: 8, "ab": 5, "a": 11, "漢字": 6, "漢子": 20}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _word_rows(variants.spelling_groups(frame)) == _variants(counts)


def test_count_words(docs, texts):
    want = Counter()
    for doc, text, *_ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r["word"]: r["n"] for r in variants.count_words(docs).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5}


def test_variants_empty(spark):
    counted = variants.count_words(spark.createDataFrame([], SCHEMA))
    assert variants.spelling_groups(counted).count() == 0


def test_filters_are_lossless():
    r = np.random.default_rng(2)
    for width in (3, 17, 40, 64):
        keys = np.unique(r.integers(0, min(1 << width, 1 << 62), 500, dtype=np.uint64))
        assert (phrases.restore(phrases.permute(keys, width), width) == keys).all()
        if width < 20:
            assert len(np.unique(phrases.permute(np.arange(1 << width, dtype=np.uint64), width))) == 1 << width
        counts = r.choice([1, 2, 254, 255, 256, 10**12], len(keys))
        back = phrases.QuotientFilter.decode(phrases.QuotientFilter.encode(keys, counts, width))
        assert (back[0] == keys).all() and (back[1] == counts).all()
        both = phrases.QuotientFilter.merge([back, (keys[:9], counts[:9])])
        assert (both[0] == keys).all() and both[1].sum() == counts.sum() + counts[:9].sum()


def _collocations(texts, longest, least, share, top):
    found = defaultdict(Counter)
    for _, text, lang, *_ in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    found[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, c in found.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        often = {k: a for k, a in c.items() if len(k) > 1 and a >= least}
        inside = {k[i : i + m] for k, a in often.items() for m in range(2, len(k)) for i in range(len(k) - m + 1)
                  if 100 * a >= share * often[k[i : i + m]]}
        rows = []
        for k, a in often.items():
            if k not in inside:
                cuts = [(1000 * a * n // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k))]
                score, _, left, right = min(cuts)
                rows.append((-score, -a, " ".join(k).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, share, top", [(20, 100, 2000), (5, 60, 25)])
def test_collocations(docs, texts, monkeypatch, least, share, top):
    monkeypatch.setattr(phrases, "SLICE", 20_000)
    monkeypatch.setattr(phrases, "SLICE_WORDS", 500)
    got = phrases.collocations(docs, least=least, share=share, top=top)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == _collocations(texts, 5, least, share, top)


def test_collocations_empty(spark, docs):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
