"""Importance resampling against a plain count of every run of words, and against its SQL."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomvec.llm import importance, lexing
from loomvec.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = ("doc_id", "n_features", "weight", "score", "rank")


def buckets(text):
    words = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target):
    """Rows of (doc_id, n_features, weight, score, rank)."""
    found = [(i, *buckets(t)) for i, t in docs]
    s = collections.Counter(b for _, bs, _ in found for b in bs)
    t = collections.Counter(b for text in target for b in buckets(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, bs, n in found:
        weight, h = sum(gain[b] for b in bs), int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    return [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < 20]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v or 0) for v in r))


@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=80)), min_size=1, max_size=8))
def test_crc_of_joined_strings(pairs):
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = importance.crc_joined(left, right, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def odd(odd_rows):
    many = [(100 + i, f"Common start {'the and of ' * (i % 9)}word{i % 7} END-{i} zwei drei") for i in range(200)]
    return odd_rows + many + [(900, "same same same " * 400), (901, "SAME same"), (902, "x" * 5000 + " y " + "x" * 5000)]


TARGET = ["the word common start", None, "", "Same text here again", "漢字 text"]


def run(spark, docs, rows):
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TARGET)], "item_id long, text string, cell int")
    return importance.draw(docs(rows), target).collect()


def test_odd_rows(spark, docs, odd_rows):
    rows = odd(odd_rows)
    assert order(run(spark, docs, rows)) == order(plain(rows, TARGET))


def test_small_blocks_and_many_cells(spark, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(importance, "BLOCK_ROWS", 17)
    monkeypatch.setattr(importance, "CELL_BYTES", 3000)
    rows = odd(odd_rows)
    want = order(plain(rows, TARGET))
    assert order(run(spark, docs, rows)) == want


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["stone river", "river stone stones", "stone", None, "internationalisation internationalization"])
    for spoil in (lambda h: h % np.uint64(2), lambda h: h * np.uint64(0)):
        words = lexing.split_words(texts)
        words.hash = spoil(words.hash)
        number, first = importance._numbered(words)
        raw = words.data.tobytes()
        spelt = [raw[a:b] for a, b in zip(words.start, words.end)]
        assert len(set(number.tolist())) == len(set(spelt)) == len(first) == len(set(zip(number.tolist(), spelt)))
        assert [spelt[f] for f in first[number]] == spelt


def test_a_hot_run_goes_to_several_cells():
    import pyarrow as pa

    texts = pa.array(["very common phrase"] * 3000 + [f"other words {i}" for i in range(3000)])
    first = [next(importance._array(r["counts"], r["sizes"][2]).sum() for r in importance._block(texts, 50, b) if "cell" in r and r["sizes"][1] > 4 * 2900) for b in (3, 4)]
    where = [next(r["cell"] for r in importance._block(texts, 50, b) if "cell" in r and r["sizes"][1] > 4 * 2900) for b in (3, 4)]
    assert first[0] >= 3000 and where[0] != where[1]


def test_a_stage_holds_one_python_worker_a_task(spark, docs):
    cells = importance.postings(docs([(i, f"word {i} of") for i in range(20)]), "doc_id", "text", 5)
    plan = importance.bucket_sums(cells)._jdf.queryExecution().executedPlan().toString()
    stages = [len(re.findall(r"\w+In(?:Arrow|Pandas)\b", stage)) for stage in plan.split("Exchange")]
    assert sum(stages) == 3 and max(stages) == 1  # each Python operator of a stage has a worker of its own, beside the others


def test_blocks_of_a_task_share_rows(spark, docs, odd_rows, monkeypatch):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        monkeypatch.setattr(importance, "BLOCK_ROWS", 7)
        rows = odd(odd_rows)
        one = docs(rows).coalesce(1)
        posted = importance.postings(one, "doc_id", "text", 200).collect()
        cells = [r.cell for r in posted if r.strings is not None]
        assert len(cells) == len(set(cells)) and [len(r.words) for r in posted if r.words is not None] == [8 * len(rows)]
        monkeypatch.setattr(importance, "HELD_BYTES", 2000)
        assert len({r.block for r in importance.postings(one, "doc_id", "text", 200).collect()}) > 1
        assert order(importance.draw(one, spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")).collect()) == order(plain(rows, TARGET))
    finally:
        spark.conf.set(batch, before)


def test_a_dictionary_has_each_string_once():
    import pyarrow as pa

    texts = ["a b a b a b", "b a", "", "é a b", "x" * 100_000 + " a b " + "x" * 100_000, "a\nb c"]
    rows = [r for k in (0, 3) for r in importance._block(pa.array(texts[k:] + texts[:k]), 1, k) if "cell" in r]
    found = importance.Dictionary(rows)
    want = [{" ".join(w[i : i + n]).encode() for w in map(WORD.findall, texts) for i in range(len(w) - n + 1)} for n in (1, 2, 3)]
    assert [sorted(b.tolist()) for b in found.buckets] == [sorted(zlib.crc32(s) % 10_000 for s in strings) for strings in want]


def test_empty_tables(spark, docs):
    assert run(spark, docs, []) == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = [(i, f"word {i} " * 15) for i in range(60)]
    assert order(importance.draw(docs(rows), nothing).collect()) == order(plain(rows, []))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whole_table_against_plain_count_and_sql(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries()["op12_importance_resampling"](spark, SF)
    assert tuple(got.columns) == FIELDS and {t for _, t in got.dtypes} == {"bigint"}
    rows = order(got.collect())
    assert rows == order(plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.select("text").collect()]))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows == order(con.sql(f"SELECT {', '.join(FIELDS)} FROM ({oracle_sql()['op12_importance_resampling']})").fetchall())
