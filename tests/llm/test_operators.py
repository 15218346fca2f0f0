"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import chat_format, components, decontaminate, exact_dedup, line_dedup, near_dedup, pieces, pii, quality, token_files, toxicity

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LINE = "The same long line in several documents"
ROWS = [
    (1, f"{LINE}\nfirst text here\n{LINE.upper()}  "), (2, f"{LINE}\nsecond"), (3, f" {LINE}\nthird\n\n"), (4, None), (5, ""), (6, f"{LINE}\nfirst text here\n{LINE.upper()}  "),
    (7, "short\nshort\nshort"), (8, "Mail a.b@c.de or +49 170 1234567, 10.0.0.255 and 4111 1111 1111 1111"), (9, "word " * 30_000), (10, "Äöü ÄÖÜ ñandú 你好 😀\n" * 3), (11, "ÄÖÜ äöü"), (None, "no id"), (12, "first text here"), (13, "FIRST text here"),
]
EXTRA = ["score", "kept", "component_id", "n_words"]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that operators make are there already."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(-1).alias(c) for c in EXTRA], F.lit("en").alias("lang"), F.lit("src").alias("source"), F.length("text").cast("long").alias("n_chars")).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_line_dedup(docs, none):
    where = defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in ROWS:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                where[key(x)].add(i)
    want = []
    for i, t in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(where[key(x)]) < 3 or i == max(where[key(x)])]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert rows(line_dedup.op1(docs)) == sorted(want, key=repr)
    assert rows(line_dedup.op1(none)) == []


def test_line_dedup_of_shared_ids(spark):
    """Two texts under one doc_id: a document once where documents are counted, and each text loses its own lines only."""
    a, b = "a line that others hold too", "another line that others hold"
    rows_ = [(1, f"{a}\nunique text of the first row"), (1, f"unique text of the second row\n{b}"), (2, a), (3, a), (4, b), (5, b), (1, f"{a}\nunique text of the first row")]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, 1, "unique text of the first row")] * 2 + [(1, 1, "unique text of the second row"), (2, 1, ""), (3, 0, a), (4, 1, ""), (5, 0, b)]


def test_first_occurrences_are_streamed_in_order(spark, docs):
    """The plan range-partitions, sorts by key, document and position, and marks the first row without another shuffle."""
    firsts = line_dedup.first_occurrences(line_dedup.stored(line_dedup.line_occurrences(docs), "t"))
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[h1#\d+L? ASC.*h2#\d+L? ASC.*doc_id#\d+L? ASC.*pos#\d+ ASC", plan) and "rangepartitioning" in plan
    assert "hashpartitioning" not in plan and "row_number" in plan


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[low(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, sha(t)) for i in ids]
    assert rows(exact_dedup.op9(docs)) == sorted(want, key=repr)
    assert rows(exact_dedup.op9(none)) == []
    twice = docs.where("doc_id = 7").unionByName(docs.where("doc_id = 7"))
    assert sorted(r.kept for r in exact_dedup.op9(twice).collect()) == [False, True]
    left = exact_dedup.first_copies(docs.unionByName(docs))
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r[0] for r in want if r[3]), key=repr)


def test_chunks_are_cut_by_content(spark):
    """A change at the start of a long text leaves its later chunks as they were."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeinost") for _ in range(rng.randint(2, 9))) for _ in range(5000))
    df = spark.createDataFrame([(1, text), (2, "something else " + text)], "doc_id long, text string")
    got = {r.doc_id: set(r.ids) for r in exact_dedup.chunks(df).groupBy("doc_id").agg(F.collect_list("fp").alias("ids")).collect()}
    assert len(got[1] & got[2]) > 0.8 * len(got[1])


def test_clashing_fingerprints_stay_apart(spark):
    parts = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (2, 12, 2)], "fp long, p1 long, p2 long")
    assert rows(exact_dedup.chunk_store(parts)) == [(1, 2, False), (2, 1, True)]


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "x"), (1, 3, "ann", "y"), (None, 0, "ann", "z"), (2, 0, "system", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = chat_format.rotate(df, block=2).collect()
    whole = defaultdict(list)
    for r in got:
        whole[r.conv_id, r.perspective].append(r)
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for (conv, who), rs in whole.items():
        rs.sort(key=lambda r: r.seq)
        text = "".join(r.segment for r in rs)
        assert [r.seq for r in rs] == list(range(1, len(rs) + 1))
        for r in rs:
            assert text[r.start : r.end] == r.segment
            assert (r.target_start is not None) == (r.role == who)
            if r.target_start is not None:
                assert text[r.target_start : r.target_end].endswith("<|end|>\n") and "<|assistant|>" not in text[r.target_start : r.target_end]
    assert chat_format.rotate(df.limit(0)).count() == 0


def windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return w, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("block_bytes", "piece"), [(10**9, 2000), (240, 2000), (10**9, 3)])
def test_decontaminate(spark, docs, none, block_bytes, piece, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    rng = random.Random(3)
    vocab = ["the", "of", "zebra", "quark", "ñu", "a1", "b2", "co", "da", "el", "fo", "ga"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate((14, 12, 3, 1, 20, 11))] + [(77, None), (78, "..."), (None, "quark zebra quark"), (3, "quark of")]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [f"x {items[0][1].upper()} y {items[1][1]}", items[4][1][:60], f"before, {'; '.join((items[5][1] or '').split())}", None, ""]
    d = spark.createDataFrame([(i % 41, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_hit", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in enumerate(texts):
        w, _ = windows(t)
        hit, found = set(), set()
        for item, text in items:
            for win in windows(text)[1]:
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit.update(range(p, p + len(win)))
                        found |= {str(item)} if item is not None else set()
        want.append((i % 41, len(w), len(hit), sorted(found), bool(hit)))
    got = decontaminate.contamination(d, b, block_bytes=block_bytes)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert decontaminate.op2(none, b).count() == 0
    assert {r.contaminated for r in decontaminate.op2(docs, b.limit(0)).collect()} == {False}
    assert decontaminate.clean_of(d, b).count() == sum(not x[4] for x in want)


def near_items(texts, items, size, slop):
    """Items, document by document, of which a window is near and none is exact: each word within slop places of its own beside the rarest."""
    split = [windows(t)[0] for t in texts]
    df = Counter(x for w in split for x in w)
    out = []
    for w in split:
        exact, near = set(), set()
        for item, text in items:
            for win in windows(text, size)[1]:
                at = min(range(len(win)), key=lambda j: (df[win[j]], j))
                for p in range(len(w)):
                    if w[p] == win[at] and all(win[j] in w[max(0, p + j - at - slop) : max(0, p + j - at + slop + 1)] for j in range(len(win))):
                        near.add(str(item))
                        if p >= at and tuple(w[p - at : p - at + len(win)]) == win:
                            exact.add(str(item))
        out.append(sorted(near - exact))
    return out


@pytest.mark.parametrize(("slop", "size"), [(2, 10), (1, 4), (2, 3)])
def test_proximity(spark, slop, size):
    rng = random.Random(slop * size)
    vocab = [f"w{i}" for i in range(14)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate((14, 12, 3, 20, 11, 6, 1))]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    for _, text in items * 12:
        w = text.split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w = w[:k] + [rng.choice(vocab)] * rng.randint(0, 1) + w[k + rng.randint(0, 1) :] or ["w0"]
        texts.append(" ".join(["w1", *w, "w2"]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: list(r.near_ids) for r in decontaminate.contamination(d, b, size=size, slop=slop).collect()}
    want = near_items(texts, items, size, slop)
    assert sum(map(len, want)) > 10 and [got[i] for i in range(len(texts))] == want


def test_repeated_benchmark_rows_are_taken_once(spark):
    b = spark.createDataFrame([(1, "some words that come again")] * 500 + [(1, None), (2, "")], "item_id long, text string")
    assert decontaminate.item_pieces(b, 10).count() == 1


def test_packing():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 2**bits, 10_001, dtype=np.uint64).astype(np.uint32)
        packed, offsets = token_files.pack(ids, bits)
        assert len(packed) <= (len(ids) * bits + 7) // 8 + len(offsets)
        for a, b in ((0, 10_001), (4095, 4097), (5000, 5000), (10_000, 10_001), (17, 9000)):
            assert (token_files.unpack(packed, offsets, bits, a, b) == ids[a:b]).all()
    assert token_files.bits_for(49_408) == 16 and token_files.bits_for(2) == 1


def odd_texts(n=400):
    rng = random.Random(5)
    signs = "abcDEfsStT'’rReévllmdM ÄäÖßµªº²½\n\t\x0b\x1c\x85\xa0\xad.,!?<|>0123İΣσ\u0301中▁"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["".join(chr(rng.randint(0, 255)) for _ in range(40)) for _ in range(n)] + ["", "<|endoftext|> x", "don't'S 'LL"]


def test_encoder_is_the_library():
    e = token_files.Encoder(BPE)
    texts = odd_texts()
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows(token_files.op4(docs, BPE)) == sorted(want, key=repr)
    assert rows(token_files.op4(none, BPE)) == []


def test_random_access(spark, docs, tmp_path):
    out = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, out, BPE, 2, 49_408)
    got = token_files.read_range(spark, out, [5, 8]).collect()
    e = token_files.Encoder(BPE)
    assert {r.doc_id: r.ids for r in got} == {i: [*e.encode([t or ""])[0].tolist(), 2] for i, t in ROWS if i in (5, 8)}


def test_pieces_are_the_library():
    import sentencepiece

    m, library = pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [*odd_texts(), *[t or "" for _, t in ROWS]]:
        assert m.encode(t).tolist() == library.encode(t)
        assert m.decode(m.encode(t)) == t.replace("▁", " ")


def test_viterbi_of_a_unigram_model():
    """The best score over all segmentations, by brute force."""
    m = pieces.PieceModel(PIECES)
    m.merges, m.ids = False, {"a": 0, "b": 1, "ab": 2, "aba": 3, "ba": 4}
    m.signs = frozenset("ab")
    m.pieces, m.scores, m.penalty, m.bytes = list(m.ids), [-2.0, -2.5, -3.0, -6.0, -2.9], -20.0, {}
    m.automaton = pieces.ahocorasick.Automaton()
    for p, i in m.ids.items():
        m.automaton.add_word(p, (len(p) - 1, i, m.scores[i]))
    m.automaton.make_automaton()

    def best(t):
        return 0.0 if not t else max([m.scores[i] + best(t[len(p) :]) for p, i in m.ids.items() if t.startswith(p)])

    for k in range(1, 9):
        for x in range(2**k):
            t = "".join("ab"[x >> j & 1] for j in range(k))
            assert sum(m.scores[i] for i in m.solve(t)) == pytest.approx(best(t))


def test_piece_queries(docs, none):
    assert all(r.round_trip for r in pieces.op7(docs, PIECES).collect())
    assert pieces.op7(none, PIECES).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES)
    assert rows(back) == sorted([(i, t or "") for i, t in ROWS], key=repr)


def components_of(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_components(spark):
    rng = random.Random(2)
    for links in ([(i, i + 1) for i in range(30)], [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)], [(0, i) for i in range(1, 20)], []):
        df = spark.createDataFrame(links, "a long, b long")
        nodes = {x for a, b in links if a != b for x in (a, b)}
        assert {r.node: r.component for r in components.components(df).collect()} == components_of(nodes, [x for x in links if x[0] != x[1]])


def near_brute(rows_, k, percent):
    sets = {}
    for i, t in rows_:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    least = components_of(sets, links)
    return sorted((i, len(sets[i]), least[i], least[i] == i) for i in sets)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, k, percent):
    """Families whose members drift, so that stars leave open buckets behind."""
    rng = random.Random(k)
    out = []
    for family in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 30, 90, 160]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 16))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 5)}"
            out.append(" ".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
            if family == 5:
                base = w
    out += ["", None, "one", "ONE", "one two", " \t\n", "ä ö ü", "Ä ö ü"]
    rows_ = list(enumerate(out))
    rng.shuffle(rows_)
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit(1))
    assert rows(near_dedup.near_classes(df, k, percent)) == sorted(near_brute(rows_, k, percent), key=repr)


def test_near_dedup_of_repeated_rows(spark):
    """Every row twice: one set a node, and the links that only the last step finds."""
    rng, out = random.Random(3), []
    for size in (30, 90, 160):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 16))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 5)}"
            out.append(" ".join(w))
            base = w
    rows_ = list(enumerate(out))
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    twice = df.unionAll(df)
    wanted = near_dedup.sketches(df, 3).select(F.col("doc_id").alias("node"), "s1", "s2")
    assert sorted(r.node for r in near_dedup.full_sets(twice, wanted, 3).collect()) == [i for i, _ in rows_]
    assert rows(near_dedup.near_classes(twice, 3, 85).distinct()) == sorted(near_brute(rows_, 3, 85), key=repr)


def test_near_dedup_edges(docs, none):
    got = near_dedup.near_classes(docs)
    assert rows(got.where("doc_id is null")) == [(None, 1, None, True)]
    assert near_dedup.near_classes(none).count() == 0
    assert near_dedup.one_of_each(docs).columns == docs.columns


def test_near_dedup_of_shared_ids(spark):
    """A document of two texts is linked with all that either is linked with."""
    rows_ = [(1, "x y z"), (1, "p q r"), (2, "p q r"), (3, "x y z"), (4, "k l m"), (5, "k l m"), (5, "p q r s t"), (6, "p q r s t"), (7, "n o"), (8, "a b c"), (8, "d e f"), (9, "d e f"), (10, "a b c")]
    got = near_dedup.near_classes(spark.createDataFrame(rows_, "doc_id long, text string"), 3, 85)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8, 10: 8}
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got.collect()) == sorted((i, want[i], want[i] == i) for i, _ in rows_)


def test_template_pages_don_t_meet_on_their_template(spark):
    """Pages of one template with much of their own: none is linked, and none is even a candidate; true copies are."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(200)]
    sets = {}
    for page in range(40):
        own = [f"p{page}_{i}" for i in range(22)]
        sets[page] = sorted({hash(w) & (2**63 - 1) for w in template[: 200 - rng.randint(0, 8)] + own})
    sets[100] = sets[3][:-4]
    df = spark.createDataFrame([(k, k, np.array(v, np.int64).tobytes()) for k, v in sets.items()], "node long, s1 long, s binary")
    nodes = spark.createDataFrame([(k, k, True) for k in sets], "node long, comp long, probe boolean")
    got = [tuple(r) for r in near_dedup.prefix_pairs(nodes, df, 85).collect()]
    full = {k: set(v) for k, v in sets.items()}
    want = {(a, b) for a in full for b in full if a < b and 100 * len(full[a] & full[b]) >= 85 * len(full[a] | full[b])}
    assert want <= set(got) and (3, 100) in got and len(got) < 40


@pytest.mark.parametrize("percent", [80, 85])
def test_prefix_filter_loses_no_link(spark, percent):
    rng = random.Random(percent)
    sets = {}
    for family in range(12):
        base = [rng.randrange(2**40) for _ in range(rng.choice([1, 2, 3, 7, 20, 60, 150]))]
        for _ in range(12):
            v = [x if rng.random() > 0.08 else rng.randrange(50) for x in base][: max(1, len(base) - rng.randint(0, len(base) // 8))]
            sets[len(sets)] = set(v)
    df = spark.createDataFrame([(k, k, np.array(sorted(v), np.int64).tobytes()) for k, v in sets.items()], "node long, s1 long, s binary")
    nodes = spark.createDataFrame([(k, k, True) for k in sets], "node long, comp long, probe boolean")
    got = {tuple(r) for r in near_dedup.prefix_pairs(nodes, df, percent).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert len(want) > 100 and want <= got


@pytest.mark.parametrize("low", [0.80, 0.85])
def test_bucket_recall(low):
    """Of random pairs just above the threshold, buckets miss fewer than one in two thousand."""
    rng = np.random.default_rng(7)
    missed = n = 0
    for size in (7, 40, 200, 1000):
        for _ in range(700):
            own = max(0, int(size * (1 - low) / (1 + low)))
            pool = rng.integers(1, 2**63, size + own, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[own:])
            if len(np.intersect1d(a, b)) < low * len(np.union1d(a, b)):
                continue
            n += 1
            missed += not (near_dedup.bands(a) == near_dedup.bands(b)).any()
    assert n > 2000 and missed <= n // 2000


EM, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CA, PH = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EM.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CA.finditer(t) if 14 <= len(d(m)) <= 19 and pii.luhn(d(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PH.finditer(t) if 10 <= len(d(m)) <= 15])


def test_pii_base_spans():
    rng, a = random.Random(9), pii.automaton()
    texts = ["".join(rng.choice("0123456789.+-@ ()abZ%_é\n:/ibanhttp") for _ in range(rng.randint(0, 90))) for _ in range(5000)]
    texts += ["a" * 5000 + "@b.c", "x@y" * 300 + ".z", "1." * 500, "4111111111111111", "4111 1111 1111-1111", "İ a@b.c", "0" * 5000 + ".1.1.1"[:6]]
    texts += ["0" * 5000 + "255.1.1.1", "1" + "0" * 5000 + ".1.1.1", "A@B.C É a@b.c"]
    for t in texts:
        assert [s for s in pii.spans(t, a) if s[1] < 4] == base_spans(t)


def test_pii_added_spans_against_whole_text_search():
    """Schemes and secrets by a plain search over the whole text, without anchors."""
    rng, a = random.Random(12), pii.automaton()
    some = ["http://", "HTTPS://", "ftp://", "token", "Secret", "api_key", "=", ": ", " ", '"', "'", "a1b2c3d4e5f6a7b8", "abcdefgh", "0123456789", "x.org/?q=1", ",", ".", "É", ")", "É"]
    for _ in range(4000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(0, 30)))
        urls = [(m.start(), m.end()) for m in re.finditer(r"(?i:https?|ftp)://[^\s<>\"')\]}]*[^\s<>\"')\]}.,;:!?]", t)]
        secrets, past = [], 0
        for i in range(len(t)):
            m = next((m for c in pii.SECRET_CUES if t[: i + 1].lower().endswith(c) and i >= past and (m := pii.SECRET.match(t, i + 1))), None)
            if m and pii.secret_valid(m[1].rstrip(".")):
                past = m.start(1) + len(m[1].rstrip("."))
                secrets.append((m.start(1), past))
        got = pii.spans(t, a)
        assert [(s, e) for s, k, e in got if k == 4] == urls and [(s, e) for s, k, e in got if k == 7] == secrets


def test_pii_more_kinds(docs, none):
    a = pii.automaton()
    t = "IBAN: DE89 3704 0044 0532 0130 00, see https://x.org/a?b=1. account number 12345-678"
    assert [(pii.KINDS[k], t[s:e]) for s, k, e in pii.spans(t, a) if k > 3] == [("iban", "DE89 3704 0044 0532 0130 00"), ("url", "https://x.org/a?b=1"), ("account", "12345-678")]
    named = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.spans(t, a) if k > 3]
    assert named("İ Account number 12345678") == [("account", "12345678")] and named("HTTPS://x.org É") == [("url", "HTTPS://x.org")]
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    assert named(f'é TOKEN = "{key}" on') == [("secret", key)] and named(f"api_key: {key}.") == [("secret", key)] and named(f"Authorization: Bearer {key}") == [("secret", key)]
    assert named("token = 1234567890123456") == [] and named("the token abcdefghijklmnopqrst") == [] and named("token = aaaaaaaaaaaaaaaaaa11") == [] and named("tokens") == []
    got = {r.doc_id: r for r in pii.op10(docs).collect()}
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got.values())
    assert (got[8].n_email, got[8].n_ip, got[8].n_card, got[8].n_phone) == (1, 1, 1, 1) and got[4].spans == "" and got[4].base_sha256 == sha("")
    assert pii.op10(none).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for op, label in ((quality.op5, "quality"), (toxicity.op6, "toxic")):
        got = op(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
        y, p = got[label].to_numpy(), got["score"].to_numpy()
        pos, neg = p[y == 1], p[y == 0]
        auc = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
        print(label, "auc", auc, "accuracy", (got["predicted"] == y).mean())
        assert auc > 0.85
        assert ((got["score"] >= 0) & (got["score"] <= 1)).all()


def test_machine_identity():
    """Linear time and the sum over pairs agree."""
    rng = np.random.default_rng(1)
    m = quality.Machine(np.zeros((len(quality.STATS), quality.BINS - 1)))
    m.w, m.v = rng.normal(size=m.w.shape).astype(np.float32), rng.normal(size=m.v.shape).astype(np.float32)
    x = np.zeros((1, quality.SIZE), np.float32)
    at = rng.choice(quality.SIZE, 12, replace=False)
    x[0, at] = rng.normal(size=12)
    pairs = sum(float(m.v[i] @ m.v[j]) * x[0, i] * x[0, j] for n, i in enumerate(at) for j in at[n + 1 :])
    assert m.raw(x)[0] == pytest.approx(m.bias + float(x[0] @ m.w) + pairs, rel=1e-3)


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (5, 7, 7), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    for op in (quality.op5, toxicity.op6):
        assert op(docs, labels).count() == len(ROWS) and op(docs, labels.limit(0)).count() == len(ROWS) and op(none, labels).count() == 0
        assert op(docs.unionByName(docs), labels).count() == 2 * len(ROWS)


READER = toxicity.Reader(toxicity.Model({"idiot": 2.0, "lowe*": 2.0, "lower": 0.5}))


def test_grammar_marks():
    marks = lambda t: np.flatnonzero(READER.read(t)).tolist()
    assert marks("a quiet day") == [] and marks("you idiot") == [4]
    assert marks("idiot") == [] and marks("the idiot") == [] and marks("the idiot. the idiot. idiot!") == [] and marks("no way. idiot") == []
    assert marks("the man is an idiot") == [0] and marks("idiot, says the man") == [0] and marks("idiot drivers") == [0] and marks("lowering it") == [0]
    assert marks("not an idiot") == [] and marks("he is not an idiot") == [6] and marks("he said idiot") == [5]
    assert marks("I will kill time") == [] and marks("I will kill you") == [12]
    assert marks("idiot, all of them") == [4]


def marks_brute(text):
    """The same marks from the words' places, clause by clause, without automata."""
    x = np.zeros(16)
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        w = re.findall(r"[\w']+|[\"“”„«»]", clause)
        value = [2.0 if v == "idiot" else 0.5 if v == "lower" else 2.0 if v.startswith("lowe") and len(v) > 4 else 0.0 for v in w]
        quote = [v in toxicity.REPORTS or v in '"“”„«»' for v in w]
        closed = toxicity.ARTICLES + toxicity.TARGETS + toxicity.NEGATIONS + toxicity.THREATS
        plain = [not k and not q and v not in closed for v, k, q in zip(w, value, quote, strict=True)]
        for i, v in enumerate(w):
            aimed = any(u in toxicity.TARGETS for u in w[:i] + w[i + 1 :])
            named = any(w[j] in toxicity.ARTICLES and plain[j + 1] for j in range(len(w) - 1) if i not in (j, j + 1))
            named |= i + 1 < len(w) and plain[i + 1]
            bits = 4 * aimed + 2 * any(u in toxicity.NEGATIONS for u in w[max(0, i - 2) : i]) + any(quote[:i])
            if value[i] and (aimed or named):
                x[bits] += value[i]
            elif v in toxicity.THREATS and aimed:
                x[8 + bits] += 3.0
    return np.log1p(x)


def test_reader_against_brute_force():
    rng = random.Random(11)
    some = ["idiot", "lower", "lowering", "lowe", "kill", "matar", "you", "them", "the", "a", "la", "not", "nie", "said", '"', "tree", "köln", ".", "!", "\n", ":", ","]
    for _ in range(4000):
        text = " ".join(rng.choice(some) for _ in range(rng.randint(0, 40)))
        assert READER.read(text).tolist() == pytest.approx(marks_brute(text).tolist())


def test_reader_is_linear():
    """Clauses are read once each, also where a sign never occurs; the sum is that of all clauses."""
    text = "you idiot. " * 60_000
    start = time.process_time()
    assert READER.read(text)[4] == pytest.approx(np.log1p(2.0 * 60_000))
    assert time.process_time() - start < 20


def test_induced_entries(spark):
    """Words and stems that toxic rows favour, and no stem whose other words are clean."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("abdeklmnorst") for _ in range(7)) for _ in range(300)]
    rows_ = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 3 == 0:
            w[4], w[9] = "zounds" + rng.choice("abcdefgh"), "gadzo"
        elif i % 2:
            w[7] = "gadzam"
        rows_.append((" ".join(w), int(i % 3 == 0), i))
    got = toxicity.induce(spark.createDataFrame(rows_, "text string, y int, sketch long"))
    assert "gadzo" in got and "gadz*" not in got and any(e.startswith("zoun") for e in got)
    assert all(e.startswith(("zoun", "gadzo")) for e in got)
    assert toxicity.favour(20, 0, 100, 900) > toxicity.favour(20, 5, 100, 900) > toxicity.favour(2, 5, 100, 900)


def test_long_secrets_are_found_whole(spark):
    rnd = random.Random(1)
    signs = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    texts = [(n, f'token = "{"".join(rnd.choice(signs) for _ in range(n))}" and more') for n in (16, 512, 513, 600, 20_000)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {n: f"secret:9:{9 + n}" for n, _ in texts}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_other_tokenizers(spark, docs, name):
    """Any tokenizer's ids are the library's, whether texts can be encoded by words or not."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    encoder = token_files.Encoder(path)
    assert encoder.by_words == (name == "word_bpe_49k.json")
    texts = [t or "" for _, t in ROWS] + token_files.PROBES
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    want = {i: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in ROWS}
    assert {r.doc_id: r.ids_crc32 for r in token_files.op4(docs, path).collect()} == want


def test_ids_beyond_their_bits_are_refused():
    with pytest.raises(ValueError):
        token_files.pack(np.array([1, 8], np.uint32), 3)
    assert token_files.unpack(*token_files.pack(np.array([1, 7], np.uint32), 3), 3, 0, 2).tolist() == [1, 7]


def test_windows_take_no_more_than_said():
    import tracemalloc

    rnd = np.random.default_rng(2)
    pieces = [rnd.integers(1, 1 << 60, 2_000).tolist() for _ in range(50)]
    tracemalloc.start()
    w = decontaminate.Windows([str(k) for k in range(50)], pieces, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.ids) == 50 * 1_991 and peak < 60 * 8 * 100_000
    w = decontaminate.Windows(["a", "b", "c", "d"], [[1, 2, 3, 4], [2, 3, 4, 1, 2, 3], [5], []], 3)
    found = {tuple(r): w.items[a:z].tolist() for r, a, z in zip(w.ids.tolist(), w.item_at[:-1], w.item_at[1:], strict=True)}
    assert found == {(1, 2, 3): [0, 1], (2, 3, 4): [0, 1], (3, 4, 1): [1], (4, 1, 2): [1], (5, 0, 0): [2]}


def test_sets_of_a_small_vocabulary_are_no_pairs(spark):
    """300 sets of 100 out of 125, of which none is linked: they all meet, and nearly none is written. Links among them are kept."""
    rnd = np.random.default_rng(5)
    pool = near_dedup.mix(np.arange(1, 126, dtype=np.uint64))
    sets = [np.sort(rnd.choice(pool, 100, replace=False)) for _ in range(300)]
    near = np.sort(np.append(sets[0][:-3], near_dedup.mix(np.arange(900, 903, dtype=np.uint64))))
    rows_ = [(k, k, bytearray(s.tobytes())) for k, s in enumerate([*sets, near])]
    df = spark.createDataFrame(rows_, "node long, s1 long, s binary")
    nodes = df.select("node", F.col("node").alias("comp"), F.lit(True).alias("probe"))
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(nodes, df, 85).collect()}
    linked = {(a, b) for a in range(301) for b in range(a + 1, 301) if 100 * len(np.intersect1d(np.frombuffer(rows_[a][2], np.uint64), np.frombuffer(rows_[b][2], np.uint64))) >= 85 * len(np.union1d(np.frombuffer(rows_[a][2], np.uint64), np.frombuffer(rows_[b][2], np.uint64)))}
    assert (0, 300) in linked and linked <= got and len(got) < 450
