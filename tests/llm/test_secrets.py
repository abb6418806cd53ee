"""The secret scan on prose, with planted keys, and with long values and tokens."""

from __future__ import annotations

import os
import random

import pytest

from loomvec.llm import secret_scan

SCALES = [s for s in ("sf0.001", "sf0.01", "sf0.1") if os.path.isdir(f"/root/testdata/{s}")]


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.mark.parametrize("scale", SCALES)
def test_no_ordinary_word_is_marked_and_planted_keys_are_found(spark, scale):
    """Keys of one format, in some texts behind a name and in others bare, among the table's prose."""
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").select("doc_id", "text")
    assert secret_scan.find_secrets(docs).selectExpr("explode(spans) s").filter("s.kind = 'format'").count() == 0
    assert secret_scan.redact(docs).join(docs.withColumnRenamed("text", "was"), "doc_id").filter("text like '%[SECRET]%' and not was rlike '[0-9a-f]{24}|[:=]'").count() == 0
    rng, planted, rows = random.Random(4), {}, []
    for doc_id, text in docs.collect():
        text, key = text or "", "".join(rng.choice(LETTERS) for _ in range(28))
        if doc_id % 10 == 0:
            planted[doc_id] = (len(text) + 1, len(text) + 29)
            text = f"{text} {key} end"
        elif doc_id % 10 == 5:
            text = f"{text} api_key={key} end"
        rows.append((doc_id, text))
    got = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    marked = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "format"] for r in got}
    assert all(not spans or spans == [planted.get(i)] for i, spans in marked.items())  # nothing else
    assert sum(marked[i] == [span] for i, span in planted.items()) >= 0.9 * len(planted)


def rows_of(rng, n):
    key = lambda: "".join(rng.choice(LETTERS) for _ in range(24))
    syllables = ["the", "ta", "ble", "rea", "ding", "aba", "cade", "fa", "won", "der", "ful", "ing", "er", "st", "ou"]

    def word():
        kind, made = rng.random(), "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
        return rng.choice(["abacade", "deface", "well-known", "2024-10-11", "john.smith"]) if kind < 0.05 else made.upper() if kind < 0.1 else made.capitalize() if kind < 0.2 else made

    words = lambda: " ".join(word() for _ in range(60))
    labelled = [(i, f'{words()} token = "{key()}" {words()}') for i in range(n)]
    bare = [(n + i, f"{words()} {key()} {words()}") for i in range(n // 2)]
    return labelled, bare, [(2 * n + i, words()) for i in range(3 * n)]


def test_bare_keys_of_a_learnt_format_are_found_and_words_stay(spark, docs):
    labelled, bare, clean = rows_of(random.Random(5), 120)
    rows = labelled + bare + clean
    spans = {r.doc_id: [s.value for s in r.spans if s.kind == "format"] for r in secret_scan.find_secrets(docs(rows)).collect()}
    assert sum(len(spans[i]) == 1 and len(spans[i][0]) == 24 and spans[i][0] in text for i, text in bare) >= 0.9 * len(bare)
    assert all(not spans[i] for i, _ in labelled + clean)
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs(rows)).collect()}
    assert all(masked[i] == text for i, text in clean)
    assert all(masked[i].replace("[SECRET]", "").split() == [w for w in text.split() if len(w) != 24] for i, text in bare if spans[i])


def test_a_long_value_does_not_end_the_sample(spark, docs):
    rng = random.Random(6)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    rows = [(i, f"secret: {v}") for i, v in enumerate(values)] + [(300 + i, f"secret: {chr(97 + i) * 410_000}") for i in range(3)]
    labelled, _ = secret_scan.labelled_sample(docs(rows), 2000, 400_000, "text")
    assert sorted(labelled["assign"]) == sorted(v.encode() for v in values)
    few, _ = secret_scan.labelled_sample(docs(rows), 2000, 1000, "text")
    assert 0 < sum(map(len, few["assign"])) <= 1000
    assert len(secret_scan.labelled_sample(docs(rows), 50, 400_000, "text")[0]["assign"]) == 50


def test_memory_of_verdicts_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(secret_scan, "MEMORY", 10_000)
    formats = secret_scan.learn({"assign": [b"Zz09" * 5] * 3})
    long = [b"q%d" % i * 40_000 for i in range(5)]
    for i in range(3000):
        formats.spans(b"word%06d %s" % (i, long[i % 5] if i % 500 == 0 else b""), [])
        assert sum(map(len, formats.yes | formats.no)) <= 11_000 and formats.size <= 10_400
    assert not any(len(t) > secret_scan.REMEMBERED for t in formats.yes | formats.no)


def test_background_draws_pass_at_most_as_often_as_stated(spark):
    """The ratio test's false alarms among tokens drawn from the background itself."""
    import numpy as np

    rng = np.random.default_rng(7)
    values = ["".join(rng.choice(list("abcdef0123456789"), 10)).encode() for _ in range(300)]
    prose = {"".join(rng.choice(list("abcde"), int(n))).encode() for n in rng.integers(6, 12, 4000)}
    ordinary = secret_scan.background(secret_scan.pair_counts(sorted(prose)))
    formats = secret_scan.learn({"assign": values}, quantile=0.0, ordinary=ordinary, alarm=1e-2)
    letters = b"\0" + secret_scan._ALPHABET
    passed = 0
    for _ in range(20_000):
        out, at = [], 0
        while len(out) < 200:
            at = int(rng.choice(len(letters), p=np.exp(ordinary.log[at])))
            if at == 0:
                break
            out.append(letters[at])
        passed += len(out) >= 6 and formats.accepts(bytes(out))
    assert passed <= 20_000 * 1e-2
