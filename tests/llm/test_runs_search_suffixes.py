"""Periodic runs, ranked search and suffix dedup against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import induced_sort, periodic_runs, ranked_search, suffix_dedup

PASSAGE = "one passage that many of these documents share, long enough to be cut out of all of them but the first, word for word as it stands here"
ROWS = [
    (1, f"begin {PASSAGE} end"), (2, f"other {PASSAGE} finish äöü"), (3, None), (4, ""), (5, f"begin {PASSAGE} end"), (6, "la la la " * 30), (7, "x" * 3_000), (8, "tic tac toe " * 9 + "and " + "tic tac toe " * 9),
    (9, PASSAGE + PASSAGE), (None, f"no id {PASSAGE}"), (10, "word " * 30_000), (11, "ÄÖÜ äöü ñandú 😀 " * 20), (12, "short\nlines\there"), (13, f"😀 {PASSAGE[:99]}"), (14, f"{PASSAGE[:100]}!"),
    (20, f"{PASSAGE}?"), (20, f"{PASSAGE}!"), (21, "Short words, short words."), (21, "Short words, short words."),
]
EXTRA = ["fp", "place", "body", "tag", "runs", "start", "rank", "score", "n_terms", "terms", "h", "n", "item_id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(-1).alias(c) for c in EXTRA]).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(t):
    return hashlib.sha256(t.encode() if isinstance(t, str) else t).hexdigest()


def plain_runs(words, least=12):
    """All maximal stretches of each period, the smallest period of each."""
    ids, out = {}, {}
    t = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    for q in range(1, len(t) // 2 + 1):
        d = np.diff(np.concatenate([[0], (t[q:] == t[:-q]).astype(int), [0]]))
        for a, e in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True):
            if e + q - a >= max(least, 2 * q):
                out.setdefault((a, e + q), q)
    return sorted([(a, e - a, q) for (a, e), q in out.items()], key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rnd = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            t = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.choice([0, 1, 13, 60, 150]))]
            if len(t) > 20:
                p, a = rnd.randint(1, len(t) // 2), rnd.randrange(len(t) // 2)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(len(t))] if rnd.random() < 0.5 else t + [9] + t + t
            texts.append(t)
        length = np.array([len(t) for t in texts])
        begin = np.cumsum(length + 1) - length - 1
        joined = np.concatenate([np.array([*t, -1 - k], np.int64) for k, t in enumerate(texts)])
        got = list(zip(*(x.tolist() for x in periodic_runs.runs_of(joined, begin, length, 12)), strict=True))
        assert got == [(int(b) + a, n, q) for b, t in zip(begin, texts, strict=True) for a, n, q in plain_runs(t)]


@pytest.mark.parametrize("batch_words", [50, periodic_runs.BATCH_WORDS])
def test_periodic_runs(docs, batch_words):
    want = []
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(w)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs, batch_words=batch_words).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, 11)


def test_op11_makes_texts_repeat(spark):
    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 61}" for k in range(i % 90))) for i in range(120)] + [(None, "a b"), (1000, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = []
    for i, t in texts:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = plain_runs(w)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(listed), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert rows(periodic_runs.op11(df)) == sorted(want, key=repr)
    assert any(w[1] for w in want)


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_search(docs, items, k):
    known = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    n_docs, n_terms = sum(bool(c) for _, c in known), sum(sum(c.values()) for _, c in known)
    df = Counter(w for _, c in known for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in known:
            m = 10 + 90 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            found += [(-score, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


ITEMS = [(1, "one passage, many documents"), (2, None), (3, ""), (4, "TIC tac"), (5, "nowhere"), (None, "tic"), (6, "äöü 😀 la"), (1, "share word"), (7, "tie"), (8, "word " * 3_000)]


@pytest.mark.parametrize("k,block_pairs", [(2, 3), (10, ranked_search.BLOCK_PAIRS)])
def test_ranked_search(spark, docs, k, block_pairs):
    """Ties: ten documents of the same text; small blocks give the same."""
    ties = [(i, "a tie of equals") for i in range(100, 90, -1)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit(1))
    both = docs.select("doc_id", "text", "terms").unionByName(spark.createDataFrame(ties, "doc_id long, text string").withColumn("terms", F.lit(1)))
    assert rows(ranked_search.ranked_search(both, items, k, block_pairs)) == sorted(plain_search(ROWS + ties, ITEMS, k), key=repr)
    assert ranked_search.ranked_search(both.limit(0), items).count() == 0 and ranked_search.ranked_search(both, items.limit(0)).count() == 0


def test_scores_of_slices_are_the_same(monkeypatch, spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = ranked_search.Index([1, 2], [[3, 9], [3]])
    index.weigh(np.array([2, 1]), 4)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([5, 0, 2]), pa.array([[3, 9], [], [9]], pa.list_(pa.int64())), pa.array([[1, 4], [], [2]], pa.list_(pa.int32()))], names=list("abcd"))
    whole = list(ranked_search.scored(index, batch, 4, 7))
    monkeypatch.setattr(ranked_search, "AT_ONCE", 1)
    parts = list(ranked_search.scored(index, batch, 4, 7))
    assert len(whole) == 1 and len(parts) == 3
    assert np.array_equal(np.concatenate([s for _, s in parts], 1), whole[0][1]) and np.concatenate([i for i, _ in parts]).tolist() == [7, 8, 9]
    assert items.count() == len(ITEMS)


@pytest.mark.parametrize("budget,fits,chunk,narrow", [(2, 0, 3, 1), (7, 10, 16, 1024), (10**6, 0, 65_536, 1), (10**6, 10**6, 65_536, 1024)])
def test_suffix_order(monkeypatch, tmp_path, budget, fits, chunk, narrow):
    """Queues that hold two tuples spill at each step; no name fits memory, so that recursion goes to the end."""
    monkeypatch.setattr(induced_sort, "CHUNK", chunk)
    monkeypatch.setattr(induced_sort, "NARROW", narrow)
    rnd = random.Random(budget)
    for trial in range(60):
        k = rnd.choice([2, 3, 5, 30])
        t = [rnd.randrange(1, k) for _ in range(rnd.choice([1, 2, 5, 30, 120]))]
        t = t + t + t[: len(t) // 2] if rnd.random() < 0.4 else sum([[x] * rnd.randint(1, 5) for x in t], [])
        place, lcp = induced_sort.suffix_files(np.array([*t, 0], np.uint16), k, str(tmp_path / str(trial)), budget, fits)
        t.append(0)
        want = sorted(range(len(t)), key=lambda i: t[i:], reverse=True)
        common = lambda a, b: next(n for n in range(len(t)) if a + n == len(t) or b + n == len(t) or t[a + n] != t[b + n])
        assert place.tolist() == want and lcp.tolist() == [0, *[common(a, b) for a, b in zip(want, want[1:], strict=False)]]


def plain_suffix_dedup(docs, size):
    """By (doc_id, tag, start); rows that share doc_id and text are one document."""
    seen, cover = {}, {}
    order = sorted({(i, tag, t or "") for i, tag, t in docs if i is not None})
    for i, tag, t in order:
        raw = t.encode()
        cover[i, t] = c = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if seen.setdefault(raw[k : k + size], (i, tag, k)) != (i, tag, k):
                c[k : k + size] = b"\1" * size
    out = []
    for i, _, t in docs:
        raw = (t or "").encode()
        c = cover.get((i, t or ""), bytearray(len(raw)))
        out.append((i, len(raw), sum(c), len(re.findall(b"\1+", bytes(c))), bytes(x for x, y in zip(raw, c, strict=True) if not y)))
    return out


@pytest.mark.parametrize("size,shard_bytes,cut_places", [(100, suffix_dedup.SHARD_BYTES, suffix_dedup.CUT_PLACES), (100, 500, 40), (48, 2_000, 1)])
def test_suffix_dedup(monkeypatch, docs, size, shard_bytes, cut_places):
    monkeypatch.setattr(suffix_dedup, "CUT_PLACES", cut_places)
    tags = {(r.doc_id, r.text): r.tag for r in docs.select("doc_id", "text").distinct().withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit((1 << suffix_dedup.TAG_BITS) - 1))).collect()}
    want = plain_suffix_dedup([(i, tags[i, t], t) for i, t in ROWS], size)
    assert rows(suffix_dedup.suffix_dedup(docs, size, shard_bytes)) == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_of_near_copies(spark):
    """Passages cut at all places and put in other surroundings: anchors with many different pieces."""
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    docs = []
    for i in range(150):
        a = rnd.randrange(500)
        docs.append((i, 0, "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(60))) + base[a : a + rnd.randrange(90, 200)] + rnd.choice(["", "é", "q" * 150])))
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    want = plain_suffix_dedup(docs, 100)
    assert rows(suffix_dedup.suffix_dedup(df, 100, 10_000)) == sorted(want, key=repr)


def test_long_texts_are_cut_alike(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 1_000)
    rnd = random.Random(4)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(5_000))
    docs = [(1, 0, a), (2, 0, "zz" + a[:2_500] + "y" + a[2_400:]), (3, 0, a[1_700:])]
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    assert rows(suffix_dedup.suffix_dedup(df)) == sorted(plain_suffix_dedup(docs, 100), key=repr)


def test_sql_is_text():
    from barloom.llm.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) and all(isinstance(x, str) for x in SQL.values())
