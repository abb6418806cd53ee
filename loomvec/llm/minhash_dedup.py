"""Near-duplicate documents by banded MinHash and odd sketches.

1. Each text becomes the set of its distinct ``shingle``-word hashes (64 bits;
   A-Z lower-cased). ``bands * rows`` MinHash samples give one key a band, and
   every (sample number, value) flips one bit of an odd sketch. Documents of
   equal sets are one node; the rest of the work sees each set once.
2. Nodes that share a band key are candidates. A bucket is never turned into all
   its pairs: each member is first compared with the bucket's least member.
   Members are gathered by a grouped minimum joined back, so hot buckets split.
3. A pair survives if the population count of the XOR of its sketches, which
   estimates high similarities precisely, is within a bound that true links
   pass but for about one in ten million; survivors are confirmed on full sets.
4. Connected nodes need no more links. Buckets whose members still lie in
   different components are compared member by member in blocks of bounded size
   by sketches; a block returns a spanning forest of its close pairs, and the
   forests' components are clusters. Members of one cluster and different
   components are compared exactly, again block by block, by a product of their
   shingle incidence, and a block returns a spanning forest of its links. So no
   link is lost when similarity is not transitive, and no pair list is built.

The result is the smallest id reachable by links. With r rows in each of b
bands, a pair of similarity s is missed with probability (1 - s^r)^b, under one
in a million at 0.8 for the defaults. Null and empty texts have the empty set
and link with nothing. A very long text is hashed whole, in arrays of about 100
bytes a word. Rows that repeat an id keep one row each in the result. Null ids
count as larger than all others. Pairs exactly at the bound link; texts of equal
sets are one node, and a tie of ids changes no result but in ``one_of_each``,
where the text's hash decides. Extra columns are never read. Empty tables give
empty results. Shingles are equal when their 64-bit hashes are: within one pair
of texts, the only place where they are compared, a false match is as good as
impossible.

``one_of_each`` decides by row, not by id: a row is named by its id and a hash
of its text, so null and repeated ids are rows like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .components import components, forest
from .idfilter import IdFilter
from .lexing import U, encode_signed, grams, mix, slices, split_words
from .skew import join_back

LAST = 2**63 - 1
SKETCH_BITS = 1024
MEMBERS = 64
BLOCK = 4096
TEXTS = 512
COLUMNS = 1 << 14
ITEM = "id long, key long, n long, sid long, bands array<long>, sketch binary"


def shingle_sets(column: pa.Array, shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words = split_words(column, lower=True)
    value, inside = grams(words, shingle)
    counts = words.counts()
    first = words.first
    sets, empty = [], np.zeros(0, np.uint64)
    for i, n in enumerate(counts.tolist()):
        if n >= shingle:
            sets.append(np.unique(value[first[i] : first[i] + n - shingle + 1]))
        elif n:
            whole = U(n)
            for h in words.hash[first[i] : first[i] + n]:
                whole = mix(np.array([whole]) * U(0x9E3779B97F4A7C15) + h)[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(empty)
    return sets, counts


def set_id(values: np.ndarray) -> int:
    """Identity of a set: a mixed sum of its mixed members."""
    return int(mix(np.array([mix(values + U(0x51ED270B)).sum(dtype=np.uint64) + U(len(values))], np.uint64)).view(np.int64)[0]) if len(values) else 0


class Signer:
    """MinHash samples, band keys and odd sketches of hashed sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(977)
        self.multiply = (random.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.add = random.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]

    def sign(self, values: np.ndarray) -> np.ndarray:
        x = (values >> U(32)).astype(np.uint32)
        low = np.full(len(self.multiply), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 256):
            part = x[None, at : at + 256] * self.multiply
            part += self.add
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One key for each band of each row of samples (n x bands*rows)."""
        key = np.zeros((len(samples), self.bands), np.uint64) + np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + samples[:, r :: self.rows].astype(np.uint64))
        return key

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmaps, packed to bytes."""
        bit = (mix(samples.astype(np.uint64) + (np.arange(samples.shape[1], dtype=np.uint64) << U(32))) % U(SKETCH_BITS)).astype(np.int64)
        flat = bit + np.arange(len(samples))[:, None] * SKETCH_BITS
        odd = np.bincount(flat.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
        return np.packbits(odd.reshape(len(samples), SKETCH_BITS).astype(bool), axis=1)

    def bound(self, similarity: float) -> int:
        """Largest XOR population count that a pair of this similarity shows, but for about one in ten million."""
        k = self.bands * self.rows
        p = 1 - similarity
        differ = min(k, k * p + 5.3 * np.sqrt(k * p * (1 - p)))
        mean = SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS))
        return int(np.ceil(mean + 2 * np.sqrt(mean)))


def _items(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            for part in slices(batch, "text"):
                sets, _ = shingle_sets(part.column("text"), shingle)
                samples = np.stack([signer.sign(s) for s in sets])
                keys = encode_signed(signer.keys(samples))
                sketches = signer.sketches(samples)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), listed, pa.array([s.tobytes() for s in sketches], pa.binary())], names=["id", "key", "n", "sid", "bands", "sketch"])

    return docs.mapInArrow(build, ITEM)


def _pass_sketch(pairs: DataFrame, nodes: DataFrame, bound: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose sketches are close."""
    left = nodes.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = nodes.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    joined = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
                yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= bound))

    return joined.select("a", "b", "s_a", "s_b").mapInArrow(near, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B|, on full sets.

    Pairs are dealt by their first member and a salt, about MEMBERS pairs to a group, so that one text meets many in bounded groups.
    """
    wide = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = join_back(pairs, wide, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / MEMBERS)).alias("salt"))
    centres = dealt.select("a", F.col("a").alias("sid"), "salt").distinct()
    rows = dealt.select("a", F.col("b").alias("sid"), "salt").unionByName(centres).join(texts, "sid")

    def compare(group: pa.Table) -> pa.Table:
        sids = group.column("sid").to_numpy()
        centre, others = group.column("a")[0].as_py(), []
        own = None
        for batch in group.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                others += shingle_sets(part.column("text"), shingle)[0]
        for sid, values in zip(sids.tolist(), others):
            if sid == centre and set_id(values) == sid:
                own = values
        out = []
        for sid, values in zip(sids.tolist(), others):
            if own is not None and sid != centre and set_id(values) == sid:
                common = len(np.intersect1d(own, values, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(values) - common):
                    out.append(sid)
        return pa.table({"a": pa.array([centre] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return rows.groupBy("a", "salt").applyInArrow(compare, "a long, b long")


def _dealt(members: DataFrame, key: str, size: int) -> DataFrame:
    """Members of each key in blocks of about ``size``, once for each pair of blocks (i <= j) that their own takes part in."""
    blocks = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = join_back(members, blocks, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block of a group."""
    own = group.column("own").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left = np.flatnonzero(own == i)
    return left, left if i == j else np.flatnonzero(own == j)


def _edges(sid: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A spanning forest of the pairs: at most one edge a row, however many pairs."""
    root = forest(a, b, len(sid))
    out = np.flatnonzero(root != np.arange(len(sid)))
    return pa.table({"a": pa.array(sid[root[out]]), "b": pa.array(sid[out])})


def _clusters(members: DataFrame, bound: int, percent: int) -> DataFrame:
    """(a, b): a forest of each bucket's pairs that lie in different components and have close sketches."""

    def cross(group: pa.Table) -> pa.Table:
        sid, root, n = (group.column(c).to_numpy() for c in ("sid", "root", "n"))
        bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(sid), -1)
        left, right = _sides(group)
        a, b = [], []
        for p in left.tolist():
            q = right[(root[right] != root[p]) & (np.minimum(n[right], n[p]) * 100 >= np.maximum(n[right], n[p]) * percent)]
            q = q[np.bitwise_count(bits[q] ^ bits[p]).sum(axis=1) <= bound]
            a.append(np.full(len(q), p))
            b.append(q)
        return _edges(sid, np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)]))

    dealt = _dealt(members, "key", BLOCK).select("key", "i", "j", "own", "sid", "root", "n", "sketch")
    return dealt.groupBy("key", "i", "j").applyInArrow(cross, "a long, b long")


def _within(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): a forest of the components that links within one cluster join, from exact intersections block by block."""

    def exact(group: pa.Table) -> pa.Table:
        sid, root = (group.column(c).to_numpy() for c in ("sid", "root"))
        sets: list[np.ndarray] = []
        for batch in group.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                sets += shingle_sets(part.column("text"), shingle)[0]
        size = np.array([len(s) if set_id(s) == i else 0 for s, i in zip(sets, sid.tolist())])
        left, right = _sides(group)
        value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1  # a shingle of one member alone is in no intersection
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        take = count[place] > 1
        column, owner = shared[place[take]], owner[take]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for begin in range(0, int((count > 1).sum()), COLUMNS):
            lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
            table = np.zeros((len(sets), COLUMNS), np.float32)
            table[owner[lo:hi], column[lo:hi] - begin] = 1
            common += table[left] @ table[right].T
        union = size[left][:, None] + size[right][None, :] - common
        good = (100 * common >= percent * union) & (size[left] > 0)[:, None] & (size[right] > 0)[None, :] & (root[left][:, None] != root[right][None, :])
        p, q = np.nonzero(good)
        name, place = np.unique(root, return_inverse=True)
        return _edges(name, place[left[p]], place[right[q]])

    dealt = _dealt(members, "cluster", TEXTS).join(texts, "sid").select("cluster", "i", "j", "own", "sid", "root", "text")
    return dealt.groupBy("cluster", "i", "j").applyInArrow(exact, "a long, b long")


def _row_name(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The id, nulls last, and a hash of the text: rows of one name hold one text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(F.col(text_col).cast("string"))


def _groups(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, sid) of each row, and (sid, least, key, root) of each set that is not empty: its least row's name and its group."""
    name, key = _row_name(id_col, text_col)
    ready = docs.select(name.alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    items = keep(_items(ready, shingle, bands, rows), "minhash")
    full = items.filter("n > 0")
    nodes = keep(full.groupBy("sid").agg(F.min(F.struct("id", "key")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("sid", F.col("row.id").alias("least"), F.col("row.key").alias("key"), "n", "bands", "sketch"), "nodes")
    bound = Signer(bands, rows).bound(percent / 100)

    buckets = nodes.select("sid", F.explode("bands").alias("key"))
    pivots = buckets.groupBy("key").agg(F.min("sid").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = keep(join_back(buckets, pivots, "key"), "buckets")
    stars = keep(_pass_sketch(shared.filter("sid <> a").select("a", F.col("sid").alias("b")).distinct(), nodes, bound, percent), "stars")

    # texts of the nodes that a link could touch: each set takes its own text, once, from a row of its least row's name
    touched = keep(shared.select("sid").distinct().join(nodes.select("sid", F.col("least").alias("id"), "key"), "sid"), "touched")
    named = IdFilter(touched, "id", "key")("id", "key")
    texts = keep(ready.filter(named).dropDuplicates(["id", "key"]).join(touched, ["id", "key"]).select("sid", "text"), "texts")
    links = keep(_confirm(stars, texts, shingle, percent), "links")
    roots = keep(components(links), "roots")

    placed = shared.select("key", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y and m > 2").select("key")
    members = join_back(placed, mixed, "key").join(nodes.select("sid", "n", "sketch"), "sid")
    clusters = keep(components(keep(_clusters(members, bound, percent), "clusters")), "clusters")
    rooted = nodes.select("sid", "least", "key").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    if not clusters.isEmpty():
        inside = clusters.select(F.col("node").alias("sid"), F.col("root").alias("cluster")).join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        joins = keep(_within(inside, texts, shingle, percent), "joins")
        if not joins.isEmpty():
            tops = keep(components(joins), "tops").select(F.col("node").alias("root"), F.col("root").alias("top"))
            rooted = rooted.join(tops, "root", "left").select("sid", "least", "key", F.coalesce("top", "root").alias("root"))
    return items, rooted


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 50, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_shingles, component_id, kept."""
    items, rooted = _groups(docs, shingle, percent, bands, rows, id_col, text_col)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    found = join_back(rooted, smallest, "root").select("sid", "component")
    out = items.select("id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(found, "sid", "left")
    component = F.coalesce("component", "id")
    plain = lambda c: F.when(c < LAST, c)
    return out.select(plain(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), plain(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 50, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``: exactly one of each group, that of least id and then of least text hash, and every row without a word."""
    items, rooted = _groups(docs, shingle, percent, bands, rows, id_col, text_col)
    least = rooted.groupBy("root").agg(F.min(F.struct("least", "key")).alias("row"))
    repeated = items.filter("n > 0").groupBy("id", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    named = least.select(F.col("row.least").alias("id"), F.col("row.key").alias("key")).join(repeated, ["id", "key"], "left")
    chosen = keep(named.select(F.col("id").alias("loomvec_id"), F.col("key").alias("loomvec_key"), F.coalesce("m", F.lit(1)).alias("loomvec_rows")), "chosen")

    name, key = _row_name(id_col, text_col)
    ready = docs.withColumns({"loomvec_id": name, "loomvec_key": key})
    on = ["loomvec_id", "loomvec_key"]
    wordless = docs.filter(~F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    out = ready.join(chosen.filter("loomvec_rows = 1"), on).select(docs.columns).unionByName(wordless)
    many = chosen.filter("loomvec_rows > 1")
    if many.isEmpty():
        return out
    # rows of one name hold one text: any of them stays
    copies = ready.filter(IdFilter(many, *on)(*on)).join(many, on).groupBy(*on).agg(F.first(F.struct(*docs.columns)).alias("loomvec_row"))
    return out.unionByName(copies.select("loomvec_row.*"))
