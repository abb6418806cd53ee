"""The pipeline end to end on a small corpus, each stage held against its contract."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from loomvec.llm import quality  # noqa: E402


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "dedup_stage", "decontamination_stage", "secrets_stage", "packing_stage"]
    assert corpus_pipeline.ORACLE_SQL is None


def one_of_each_group(rows, left):
    """By brute force over rows, whatever their ids: all without a word stay, and of each group one row of its least id (nulls last)."""
    groups = {}
    for at, (_, component, _) in brute.near(list(enumerate(t for _, t in rows)), 5).items():
        if brute.WORD.search(rows[at][1] or ""):
            groups.setdefault(component, []).append(rows[at])
    last = lambda i: 2**63 if i is None else i
    assert sorted((r for r in left if not brute.WORD.search(r[1] or "")), key=repr) == sorted((r for r in rows if not brute.WORD.search(r[1] or "")), key=repr)
    worded = [r for r in left if brute.WORD.search(r[1] or "")]
    assert len(worded) == len(groups)
    for group in groups.values():
        kept = [r for r in worded if r in group]
        assert len(kept) >= 1 and all(last(i) == min(last(j) for j, _ in group) for i, _ in kept)


def test_pipeline(spark, docs, odd_rows, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("sto", "ri", "wal", "li", "mo", "ta") for b in ("ne", "ver", "king", "ght", "on", "ble")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = prose(25)
    rows = [(100 + i, prose(rng.randrange(30, 200))) for i in range(300)]
    rows += [(500 + i, "spam! " * rng.randrange(30, 200)) for i in range(150)]
    copy = prose(150)
    rows += [(700 + i, copy + f" end{i}") for i in range(20)]
    rows += [(800, prose(40) + " " + item.upper() + " " + prose(40)), (801, prose(60) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(20))]
    labels = [(i, int(not t.startswith("spam")), 0) for i, t in rows]
    documents = docs(rows + odd_rows)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == documents.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(now)
    kept = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert not any(500 <= (i or 0) < 650 for i in kept[0]) and len(kept[0] & set(range(100, 400))) >= 297
    model_says = quality.classify(documents, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert seen[0].count() == model_says.filter("predicted = 1").count()
    assert len(kept[1] & set(range(700, 720))) == 1
    one_of_each_group([(r.doc_id, r.text) for r in seen[0].collect()], [(r.doc_id, r.text) for r in seen[1].collect()])
    assert kept[2] == kept[1] - {800}
    assert kept[3] == kept[2] and "[SECRET]" in seen[3].filter("doc_id = 801").first().text
    assert kept[4] == kept[3]
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect(), key=repr) == sorted(now.select("doc_id", "piece", "ids_crc32").collect(), key=repr)


def test_dedup_keeps_one_row_of_each_group_whatever_its_id(spark, docs, odd_rows):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"word{rng.randrange(10**6)}" for _ in range(n))
    text = {c: prose(80) for c in "abcdef"}
    near = {c: t + " end" for c, t in text.items()}
    rows = odd_rows + [(None, text["a"]), (None, text["b"]), (None, near["b"]), (None, text["b"])]  # nameless: one clean, one group of three
    rows += [(20, text["c"]), (None, near["c"]), (21, text["d"]), (21, near["c"])]  # near copies of 20 beside a clean text of 21
    rows += [(22, text["e"]), (22, near["e"]), (22, text["e"]), (23, text["f"]), (23, text["f"])]
    rows += [(2, ""), (None, None), (None, " \n")]
    got = corpus_pipeline.dedup_stage(spark, docs(rows), "").select("doc_id", "text").collect()
    one_of_each_group(rows, [(r.doc_id, r.text) for r in got])
    kept = {(r.doc_id, r.text) for r in got}
    assert {(None, "no id at all"), (None, text["a"]), (9, "Ünïcode — 漢字 text"), (9, "other text of one id"), (20, text["c"]), (21, text["d"]), (7, "Same text here again"), (5, "One")} <= kept
    assert not kept & {(None, near["c"]), (21, near["c"]), (8, "Same text here again"), (6, "one")}
    words = [r for r in got if (r.text or "").strip()]
    assert sorted(c for c in text for r in words if r.text in (text[c], near[c])) == list("abcdef")
    assert len(words) == len({r for r in kept if (r[1] or "").strip()}) == 6 + 6
    assert sum(not (t or "").strip() for _, t in rows) == len(got) - len(words)
