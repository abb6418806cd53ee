"""URLs of any length: grams against plain slicing, time in proportion, and joins that broadcast nothing that grows."""

from __future__ import annotations

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from loomvec.llm import url_filter


@pytest.mark.parametrize("order", [0, 1, 5])
def test_grams_are_those_of_the_whole_text(spark, order):
    long = "".join(chr(97 + i * i % 26) for i in range(url_filter.PIECE * 3))
    texts = ["", None, "a", "é漢𝒳\nb", long[: url_filter.PIECE], long[: url_filter.PIECE + 1], long, long + "𝒳" * 300, "^" * 600]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid int, url string").select("uid", url_filter.padded(F.col("url"), order).alias("text"))
    got = {}
    for r in url_filter._grams(rows, "uid", order).collect():
        got.setdefault(r.uid, []).append(r.gram)
    for i, text in enumerate(texts):
        whole = "^" * order + (text or "")
        assert sorted(got.get(i, [])) == sorted(whole[a : a + order + 1] for a in range(len(text or "")))


def test_time_grows_with_the_length_only(spark):
    def seconds(n):
        rows = spark.range(1).select("id", F.concat(F.lit("^" * 5), F.repeat(F.lit("http://example.org/"), n // 19)).alias("text"))
        began = time.perf_counter()
        assert url_filter._grams(rows, "id", 5).agg(F.sum(F.length("gram"))).first()[0] == n // 19 * 19 * 6
        return time.perf_counter() - began

    seconds(100_000)
    short, long = min(seconds(400_000) for _ in range(2)), min(seconds(800_000) for _ in range(2))
    assert long < 3 * short + 0.5


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_no_join_broadcasts_what_grows(spark, monkeypatch, few):
    """By their file's size the characters of all URLs are the smaller side, though they are many times the different grams."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    urls = [f"http://{word(9)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es', 'fr', 'en'])}/{word(30)}" for _ in range(1_000)]
    rows, depth = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), lambda line: len(line) - len(line.lstrip(" :+-"))
    plans, write = [], url_filter.keep

    def noted(df, name):
        df.collect()
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(url_filter, "keep", noted)
    monkeypatch.setattr(url_filter, "FEW", few, raising=False)
    got = url_filter.judge(rows)
    for name, plan in plans:
        if few == 0:
            assert "Broadcast" not in plan, name
        lines = plan.splitlines()
        for i, top in enumerate(lines):
            below = itertools.takewhile(lambda line: depth(line) > depth(top), lines[i + 1 :])
            assert "BroadcastExchange" not in top or not any("Generate" in line for line in below), name
    assert [name for name, _ in plans].count("url-model") == url_filter.ORDER + 1
    counts = {r.verdict: r["count"] for r in got.groupBy("verdict").count().collect()}
    assert sum(counts.values()) == 1_000 and set(counts) == {"allow", "block"}


def test_grams_take_the_ratio_of_their_longest_seen_end(spark):
    """Counts of both classes by hand; an end that only other URLs show takes the shorter one's ratio."""
    grams = [("abc", 3, 1), ("xbc", 0, 2), ("ybc", 0, 0), ("yzc", 0, 0), ("yzw", 0, 0), ("abd", 1, 0)]
    got = {r.g: r.micro for r in url_filter.learn(spark.createDataFrame(grams, "gram string, a long, b long"), 2).collect()}

    def chance(at, gram):
        if not gram:
            return 1 / url_filter.SYMBOLS
        ends = {}
        for g in grams:
            ends[g[0][3 - len(gram) :]] = ends.get(g[0][3 - len(gram) :], 0) + g[at]
        followers = [n for g, n in ends.items() if g[:-1] == gram[:-1]]
        total, kinds, lower = sum(followers), sum(n > 0 for n in followers), chance(at, gram[1:])
        return (ends.get(gram, 0) + kinds * lower) / (total + kinds) if total + kinds else lower

    ratio = lambda gram: math.floor((math.log(chance(1, gram)) - math.log(chance(2, gram))) * url_filter.SCALE)
    want = {"abc": ratio("abc"), "xbc": ratio("xbc"), "abd": ratio("abd"), "ybc": ratio("bc"), "yzc": ratio("c"), "yzw": 0}
    assert got == want
