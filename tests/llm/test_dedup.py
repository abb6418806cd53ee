"""Near copies, repeated substrings and near vectors against brute force, with hot groups and chains."""

from __future__ import annotations

import hashlib
import os
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from loomvec.llm import embedding_dedup, minhash_dedup, substring_dedup  # noqa: E402
from loomvec.llm.components import components, forest  # noqa: E402
from loomvec.llm.idfilter import IdFilter, may_hold  # noqa: E402


def prose(rng, n, vocabulary=400):
    return [f"word{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, docs, shingle):
    rng = random.Random(shingle)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 60)))) for i in range(120)]
    base = prose(rng, 120)
    # a hot group of borderline copies: not all alike to each other, so links are not transitive
    rows += [(500 + i, " ".join(edited(rng, base, 0.08 / shingle * rng.random() * 2))) for i in range(150)]
    # a chain in which only neighbours are alike
    chain = prose(rng, 100)
    for i in range(20):
        rows.append((900 + i, " ".join(chain)))
        at = 5 * i % 100
        chain[at : at + 4] = [f"c{i}_{k}" for k in range(4)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(3000, ""), (3001, None), (3002, "A"), (3003, "a")]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs(rows), shingle=shingle).collect()}
    assert got == brute.near(rows, shingle)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_of_a_whole_table(spark, shingle):
    """Every pair at 0.8 or more of a thousand documents, and no other."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table, shingle=shingle).collect()}
    want = brute.near([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], shingle)
    assert got == want and sum(not kept for *_, kept in want.values()) > 20


def test_near_duplicates_keeps_odd_rows(docs, odd_rows, spark):
    rows = minhash_dedup.near_duplicates(docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[1, 0].component_id == 1 and by[1, 0].kept and by[2, 0].kept
    assert by[6, 1].component_id == 5 and not by[6, 1].kept
    assert by[8, 1].component_id == 7
    assert not minhash_dedup.near_duplicates(docs([])).collect()


def test_each_set_fetches_its_own_text_once(docs, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(prose(rng, 60, 10**6)) for _ in range(20)]
    rows = [(i, t + end) for t in texts for end in ("", " end") for i in (None, None, 5)]
    tables, keep = {}, minhash_dedup.keep
    monkeypatch.setattr(minhash_dedup, "keep", lambda df, name: tables.setdefault(name, keep(df, name)))
    got = minhash_dedup.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {5}
    assert tables["texts"].count() == tables["texts"].select("sid").distinct().count() == 40


def test_near_duplicates_of_many_rows_without_an_id(docs):
    """A third of the rows equal and without an id, a third different and without an id."""
    rng = random.Random(17)
    hot = " ".join(prose(rng, 40, 10**6))
    rows = [(None, hot)] * 2000 + [(None, " ".join(prose(rng, 12, 10**6))) for _ in range(2000)] + [(i, " ".join(prose(rng, 12, 10**6))) for i in range(1999)] + [(5000, hot + " end")]
    got = minhash_dedup.near_duplicates(docs(rows), shingle=2).collect()
    assert len(got) == len(rows)
    assert sum(r.component_id == 5000 for r in got) == 2001 and sum(r.kept for r in got if r.component_id == 5000) == 1
    assert sum(r.doc_id is None and r.component_id is None and r.kept for r in got) == 2000
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id is not None)


def test_sketches_estimate_high_similarity():
    signer = minhash_dedup.Signer(50, 6)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for common, alike in ((2700, True), (900, False)):
        a, b = values[:common], np.concatenate([values[: common - 150], values[2700:2850]])
        true = (common - 150) / (common + 150)
        bits = signer.sketches(np.stack([signer.sign(a), signer.sign(b)]))
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        estimate = 1 + minhash_dedup.SKETCH_BITS / (4 * 300) * np.log(1 - 2 * differ / minhash_dedup.SKETCH_BITS)
        assert abs(estimate - true) < 0.12 and (differ <= signer.bound(0.8)) == (true >= 0.8) == alike or true > 0.7


def test_substrings(docs):
    rng = random.Random(4)
    shared = [prose(rng, n, 10**6) for n in (49, 50, 55, 130)]
    rows = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 40), 10**6)
        for _ in range(rng.randrange(3)):
            words += rng.choice(shared) + prose(rng, 3, 10**6)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(shared[2])) for i in range(80)]  # a hot passage
    copy, short = " ".join(prose(rng, 90, 10**6)), " ".join(prose(rng, 49, 10**6))
    rows += [(200 + i, copy) for i in range(9)] + [(220 + i, short) for i in range(4)] + [(230, "a " + copy), (199, "b " + copy), (240, rows[3][1]), (241, rows[3][1])]
    rows += [(300, "the " * 500), (301, "the " * 60), (302, "The " * 60), (303, None), (304, " \n")]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs(rows)).collect()}
    assert got == brute.substrings(rows, 50)


def test_substrings_count_repeats_of_an_id_as_one_document(docs, odd_rows):
    rows = substring_dedup.dedup_substrings(docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows) and sum(r.n_removed for r in rows) == 0
    text = " ".join(f"t{i}" for i in range(60))
    rows = substring_dedup.dedup_substrings(docs([(1, text), (1, text), (None, text), (2, text + " more")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows) == [(False, 1, 0), (False, 1, 0), (False, 2, 60), (True, 0, 60)]
    assert not substring_dedup.dedup_substrings(docs([])).collect()


def test_substrings_of_rows_without_an_id_and_of_a_hot_passage(docs):
    """A thousand rows without an id, a passage that every third row holds, one id with many texts."""
    rng = random.Random(14)
    passage = prose(rng, 70, 10**6)
    rows = [(i if i % 2 else None, " ".join(prose(rng, 12, 10**6) + (passage if i % 3 == 0 else []) + prose(rng, 5, 10**6))) for i in range(2000)]
    rows += [(7, " ".join(passage + [f"own{i}"])) for i in range(50)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs(rows)).collect())
    first = min(i for i, t in rows if i is not None and " ".join(passage) in t)
    want = []
    for i, t in rows:
        words = t.split()
        gone = " ".join(passage) in t and i != first
        stay = t.replace(" ".join(passage), "").split() if gone else words
        want.append((i is None, i or 0, len(words), 70 if gone else 0, hashlib.sha256(" ".join(stay).encode()).hexdigest()))
    assert got == sorted(want)


def thue_morse(n, a, b):
    """The sequence of length 2**n over two symbols and its complement: equal under every polynomial hash modulo 2**64 from n = 10 on."""
    one, two = [a], [b]
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def test_words_and_windows_of_regular_structure_stay_apart(docs):
    one, two = ("".join(s) for s in thue_morse(10, "a", "b"))
    rows = [(1, f"{one} x"), (2, f"{two} x"), (3, one), (4, two), (5, f"{two} x")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs(rows), shingle=2).collect()}
    assert got == brute.near(rows, 2) and got[5][1] == 2
    one, two = (" ".join(s) for s in thue_morse(11, "p", "q"))
    rows = [(1, one), (2, two)]
    for window in (50, 1500):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs(rows), window=window).collect()}
        assert got == brute.substrings(rows, window)


def test_count_min_never_underestimates(spark, docs, monkeypatch):
    """Keys of two documents always pass the sketch, however small it is."""
    text = " ".join(f"t{i}" for i in range(80))
    ready = docs([(1, text), (2, "x " + text), (3, " ".join(f"u{i}" for i in range(80)))]).select("doc_id", "text").toDF("id", "text")
    ready = ready.withColumns({"name": F.lit(0), "cell": F.lit(0).cast("long")})
    for cells, together in ((8, 1 << 20), (1024, 1 << 20), (1024, 2)):
        monkeypatch.setattr(substring_dedup, "TOGETHER", together)
        keys = substring_dedup._keys(ready, np.zeros(1, np.uint32), 4, 50, 8).cache()
        sizes = keys.groupBy("shard").agg(F.sum("n").alias("n"))
        found = {(r.id, r.key) for r in substring_dedup._repeated(keys, substring_dedup._sketches(keys, 2, cells), sizes, 2, cells).collect()}
        assert len({k for i, k in found if i == 1} & {k for i, k in found if i == 2}) >= 1


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist(), int(rng.integers(3))) for i in range(150)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + 0.07 * rng.standard_normal(16)).tolist(), 0) for i in range(60)]
    step = centre.copy()
    for i in range(25):  # a chain of neighbours
        rows.append((2000 + i, step.tolist(), 1))
        step = step + 0.3 * rng.standard_normal(16)
    rows += [(3000 + i, rows[3][1], rows[3][2]) for i in range(30)]
    rows += [(4000, None, 0), (4001, [0.0] * 16, 0), (4002, [float("nan")] + [1.0] * 15, 0), (4003, [None] + [1.0] * 15, 0), (4004, centre.tolist(), None), (4005, [1.0, 2.0], 0), (4006, [], 0), (4007, [float("inf")] * 16, 0)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect()}
    assert got == brute.linked_vectors(rows, 0.93)
    assert not embedding_dedup.near_vectors(table.limit(0)).collect()


def test_vectors_without_or_with_one_id_are_not_one_node(spark):
    axis = lambda k: [float(i == k) for i in range(6)]
    near = lambda k: [v + 0.01 for v in axis(k)]
    rows = [(None, near(0), 0), (5, axis(0), 0), (None, near(1), 1), (9, axis(1), 1), (30, near(2), 0), (20, axis(2), 0), (30, near(3), 1), (25, axis(3), 1), (None, axis(4), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table).collect()), key=repr)
    want = [(None, 1, 5, False), (5, 1, 5, True), (None, 1, 9, False), (9, 1, 9, True), (30, 1, 20, False), (20, 1, 20, True), (30, 1, 25, False), (25, 1, 25, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    rows = [(i, (centres[i % 6] + 0.12 * rng.standard_normal(12)).tolist(), 0) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect()}
    assert got == brute.linked_vectors(rows, 0.93)


def test_vectors_in_cells(spark, monkeypatch):
    """Labels of many vectors are dealt into cells several times; every link is still counted once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    bits, tables = embedding_dedup.cells_for(900, 0.93, 1e-6)
    assert bits >= 6 and tables < 2**bits and embedding_dedup.cells_for(8, 0.93, 1e-6) == (0, 1)
    rng = np.random.default_rng(31)
    centres = rng.standard_normal((150, 24))
    rows = [(i, (centres[i % 150] + 0.2 * rng.standard_normal(24)).tolist(), 0) for i in range(900)]
    rows += [(2000 + i, (centres[0] + 0.01 * rng.standard_normal(24)).tolist(), 0) for i in range(40)]  # one hot cell
    rows += [(3000 + i, rng.standard_normal(24).tolist(), 1) for i in range(20)] + [(4000, rows[5][1], 0), (4001, rows[5][1][:23], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cells string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect()}
    want = brute.linked_vectors(rows, 0.93)
    assert got == want and sum(n for n, _ in want.values()) > 2000


def test_components_and_forest(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    nodes = sorted({n for link in links for n in link})
    want = brute.roots(nodes, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want[n] for n in nodes if any(a != b and n in (a, b) for a, b in links)}
    place = {n: i for i, n in enumerate(nodes)}
    a, b = (np.array([place[x[k]] for x in links]) for k in (0, 1))
    assert [nodes[r] for r in forest(a, b, len(nodes))] == [want[n] for n in nodes]


def test_id_filter_has_no_false_negative(spark):
    ids = spark.range(0, 5000, 7)
    made = IdFilter(ids, "id")
    passed = {r.id for r in spark.range(5000).filter(made("id")).collect()}
    assert set(range(0, 5000, 7)) <= passed and len(passed) < 1500
    cells = spark.range(5000).select(made.cell(F.col("id")).alias("cell")).toPandas().cell.to_numpy()
    assert set(np.flatnonzero(may_hold(made.table, cells)).tolist()) == passed
    assert spark.range(5).filter(IdFilter(spark.range(0), "id")("id")).count() == 0
