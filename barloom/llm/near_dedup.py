"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Each text's shingle set is hashed once; a hash falls in one of BINS bins, each bin keeps its least value, and an empty
bin borrows from a bin that a hash of (bin, attempt) points to, the same for all texts. Bands of ROWS bins are bucket keys.
Within a bucket only the edges of a star are proposed, never all pairs. Proposed links are confirmed on full sets. Stars
that leave a bucket in several components are followed by stars around other centres, and at last by an exact prefix filter
between the components that are left, so that no link between different texts is lost to the star shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.shared import stored

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: 64-bit numbers of a set's parities.
FOLDS = 8
#: Distinct words whose hashes a worker keeps.
CACHE = 400_000

_U = np.uint64
_MIX = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits: shifts and odd factors, invertible."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _MIX[3]
        x = (x ^ (x >> _U(29))) * _MIX[0]
        return x ^ (x >> _U(32))


def donors(tries: int = 4 * BINS) -> np.ndarray:
    """The bins that each empty bin tries in turn: a fixed pseudo-random table, the same everywhere."""
    at = np.arange(BINS, dtype=np.uint64)[:, None] * _U(1_000_003) + np.arange(tries, dtype=np.uint64)[None, :]
    return (mix(at + _U(17)) % _U(BINS)).astype(np.int64)


DONORS = donors()


class Shingler:
    """Sets of k-word shingles as sorted 64-bit hashes."""

    def __init__(self, k: int):
        self.k, self.words = k, {}

    def set_of(self, text: bytes | None) -> np.ndarray:
        w = text.lower().split() if text else []
        if not w:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > CACHE:
            known.clear()
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh3_64_intdigest(x)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        n = min(self.k, len(w))
        total = np.full(len(w) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                total = mix(total * _MIX[1] + h[i : len(w) - n + 1 + i])
        return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation sketch: the least hash of each bin, empty bins densified."""
    bins = (hashes % _U(BINS)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    # hashes ascend, so the first of each bin is its least
    at, first = np.unique(bins, return_index=True)
    least[at] = hashes[first]
    full = np.zeros(BINS, bool)
    full[at] = True
    if len(at) < BINS:
        empty = np.flatnonzero(~full)
        hit = full[DONORS[empty]]
        which = hit.argmax(1)
        source = DONORS[empty, which]
        missed = ~hit[np.arange(len(empty)), which]
        source[missed] = at[0]
        with np.errstate(over="ignore"):
            least[empty] = mix(least[source] + which.astype(np.uint64) + _U(1))
    return least


def bands(hashes: np.ndarray) -> np.ndarray:
    sig = signature(hashes).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + _U(1)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * _MIX[2] + sig[:, r])
    return key.astype(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, keys): set size, 128 bits that name the set, bucket keys (null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            n, s1, s2, keys = [], [], [], []
            for text in batch.column(1):
                got = shingler.set_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                n.append(len(got))
                first, second = set_name(got)
                s1.append(first)
                s2.append(second)
                keys.append(bands(got) if len(got) else None)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "s1", "s2", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return stored(rows.mapInArrow(sketch, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"), "sketches")


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    name = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, s1, s): the full shingle sets, as bytes of ascending hashes, of wanted(node, s1, s2): those sets that s1 and s2 name among the texts of doc_id node; one row each, however often docs has its row."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            nodes, names, sets = [], [], []
            for node, text, *name in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                got = shingler.set_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                if set_name(got) == tuple(name):
                    nodes.append(node)
                    names.append(name[0])
                    sets.append(got.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["node", "s1", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(wanted, "node").select("node", "text", "s1", "s2")
    return stored(rows.mapInArrow(expand, "node long, s1 long, s binary").dropDuplicates(["node", "s1"]), "shingle-sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) of which full sets have 100 * intersection >= percent * union; once for each such pair of their sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (len(p), len(q)) if len(p) < len(q) else (len(q), len(p))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def pairs_of(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of (x, y)."""
    return rows.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members(key, node) with each node's component so far."""
    return members.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))


def open_buckets(rows: DataFrame) -> DataFrame:
    """Those of (key, node, comp) whose bucket holds several components."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return rows.join(stored(keys, "open-keys"), "key")


def size_band(n: Column) -> Column:
    """Sizes in bands, each at most a twentieth wider than it begins."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05))).cast("int")


def parities(hashes: np.ndarray) -> np.ndarray:
    """FOLDS numbers whose bits say, for each place, whether an odd number of the set's hashes falls there.

    Where two sets' bits differ, some hash is in one of them alone; so two sets of sizes m and n with d differing bits
    share (m + n - d) / 2 hashes at most.
    """
    odd = np.bincount((hashes % _U(64 * FOLDS)).astype(np.int64), minlength=64 * FOLDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b): all pairs of a probe and a node of another component that can be linked, of nodes(node, comp, probe).

    Shingles are ordered from rare to frequent, the same for all. If two sets of sizes m and n share o shingles, their first
    common one stands at place m - o or before in one and n - o or before in the other (from 0); a link needs
    o >= percent * (m + n) / (100 + percent), and o <= min(m, n). Each set puts forward, for every band of sizes that a partner
    can have, the shingles that stand early enough for the band's least partner, and sets meet on shingle and both bands:
    pages of one template, each with rare shingles of its own, don't meet on the template's frequent ones. Sets that meet
    are a pair only if their parities leave room for the overlap, so texts made of one small vocabulary, which all meet, are
    not all written as pairs. No link is lost.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parities(np.frombuffer(s.as_buffer(), np.uint64)).tolist() for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.list_(pa.int64()))], names=["node", "s1", "bits"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1)]
            n = np.array([len(x) for x in each], np.int64)
            owner = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([*owner, pa.array(np.concatenate(each) if each else np.zeros(0, np.int64))], names=["node", "s1", "shingle"])

    chosen = sets.join(nodes.select("node"), "node", "left_semi").select("node", "s", "s1")
    folded = stored(chosen.select("node", "s1", "s").mapInArrow(fold, "node long, s1 long, bits array<long>"), "parities")
    tokens = stored(chosen.mapInArrow(spread, "node long, s1 long, shingle long"), "shingles")
    df = stored(tokens.groupBy("shingle").agg(F.count("*").alias("df")), "shingle-counts")
    lists = tokens.join(df, "shingle").groupBy("node", "s1").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    n = F.size("s")
    head = F.transform(F.slice("s", 1, n - F.ceil(n * percent / 100).cast("int") + 1), lambda t: t["shingle"])
    heads = stored(lists.select("node", "s1", n.alias("n"), head.alias("head")).join(folded, ["node", "s1"]).join(nodes, "node").withColumn("band", size_band(F.col("n"))), "prefixes")
    bands = heads.groupBy("band").agg(F.min("n").alias("least"), F.max("n").alias("most")).select(F.col("band").alias("other"), "least", "most")
    # A band has a row for each twentieth of growth: a few hundred at most, whatever the input.
    met = heads.join(F.broadcast(bands), (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100))
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    places = F.col("n") - F.ceil(percent * (F.col("n") + partner) / (100 + percent)).cast("int") + 1
    put = met.select("node", "n", "comp", "probe", "bits", "band", "other", F.posexplode(F.slice("head", 1, F.greatest(F.lit(0), places))).alias("i", "shingle"))
    put = stored(put, "put-forward")
    x = put.where("probe").select("shingle", F.col("other").alias("band"), F.col("band").alias("other"), *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "i", "comp", "bits")])
    need = F.ceil(percent * (F.col("x_n") + F.col("n")) / (100 + percent))
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("x_bits")[k])) for k in range(FOLDS)), F.lit(0))
    room = F.col("n") + F.col("x_n") - apart >= 2 * need
    able = room & (F.col("comp") != F.col("x_comp")) & (F.col("i") <= F.col("n") - need) & (F.col("x_i") <= F.col("x_n") - need)
    return pairs_of(x.join(put, ["shingle", "band", "other"]).where(able).select(F.col("x_node").alias("x"), F.col("node").alias("y")))


def near_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A text's set is its distinct shingles of so many words (`[^\\x20\\x09-\\x0D]+` after lower-casing A-Z); with fewer words the
    whole sequence is the one shingle. Documents are linked where 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable, and the row with that doc_id is kept. Texts without words are linked with nothing. Rows that share a
    doc_id are one document: it is linked with all that any of its texts is linked with. A row without doc_id is linked with nothing, has no component_id and is kept.
    Other columns are neither read nor returned.
    """
    known = sketches(docs, shingle)
    live = known.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Equal sets are one class, for which its least doc_id stands. A doc_id of several texts may stand for several classes: it is one node.
    classes = stored(live.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    heads = live.select(F.col("doc_id").alias("node"), "s1", "s2", "keys").join(classes, ["node", "s1", "s2"]).select("node", F.explode("keys").alias("key"))
    shared = heads.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where(F.col("centre") != F.col("other")).select("key", "centre")
    members = stored(heads.join(stored(shared, "shared-keys"), "key").select("key", "node", "centre"), "buckets")
    sets = full_sets(docs, classes.join(members.select("node").distinct(), "node").select("node", "s1", "s2"), shingle)

    # Stars around each bucket's least node.
    tried = stored(pairs_of(members.select(F.col("centre").alias("x"), F.col("node").alias("y"))), "pairs")
    links = stored(confirm(tried, sets, percent), "confirmed")
    comps = components(links)
    # Stars around another centre of each bucket that is still in several components.
    rest = stored(open_buckets(labelled(members, comps)), "open-buckets")
    centres = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("centre"), F.col("comp").alias("centre_comp"))).alias("c")).select("key", "c.centre", "c.centre_comp")
    again = rest.join(stored(centres, "centres"), "key").where(F.col("comp") != F.col("centre_comp")).select(F.col("centre").alias("x"), F.col("node").alias("y"))
    more = stored(pairs_of(again).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = stored(links.unionByName(confirm(more, sets, percent)), "confirmed")
    comps = components(links)
    # What is left: nodes outside their bucket's largest component, against other components, by an exact filter.
    rest = stored(open_buckets(labelled(rest.select("key", "node"), comps)), "open-buckets")
    largest = rest.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("largest"))
    probes = rest.join(stored(largest, "largest"), "key").groupBy("node", "comp").agg(F.max(F.col("comp") != F.col("largest")).alias("probe"))
    last = stored(prefix_pairs(stored(probes, "probes"), sets, percent), "pairs")
    links = links.unionByName(confirm(last, sets, percent))

    # A doc_id of several sets links their classes.
    several = live.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    same = live.join(several, "doc_id").join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comps = components(stored(links.unionByName(same), "confirmed"))
    named = classes.join(comps, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id"))
    out = known.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: the smallest doc_id of each component, and rows without doc_id."""
    gone = near_classes(docs, shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def op8(docs: DataFrame) -> DataFrame:
    return near_classes(docs, shingle=3, percent=85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.r),
c AS (SELECT doc_id, min(r) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
