"""Language identification by Bayesian fusion of four kinds of evidence.

* text: a multinomial model over hashed byte trigrams, trained on at most
  ``sample`` documents of each language (those of least hash of id and text), as a
  table of fixed size; the log-likelihood is tempered by the text's length.
* markup: the declared ``lang`` attribute. P(declared | language) is estimated
  over all pages from the text's own answer.
* suffix: the last label of the host, P(suffix | language), estimated likewise.
* host: P(language | host), smoothed towards P(language | parent domain), which
  is smoothed towards the language's share of all pages, by grouped aggregates.

Every grouped table holds soft counts, sums of text posteriors, with map-side
combine, so one host with a third of all pages is a row like any other. Pages
meet the tables by joins on an image of the key, which adaptive execution may
split or broadcast.

Null pages and texts give no text evidence, null URLs an empty host, missing
declarations an empty one. Very long pages are read whole, in time in proportion
to their length. Ties go to the first language by name. Without training
documents the result is empty of languages: ``lang`` is null. Repeated pages get
a row each; repeated training rows (of one id and text) count once.

Every language with training documents is modelled. Trigram counts stay in a
shared table; pages meet them LANGUAGES languages at a time, each block's
log-likelihoods appended to the kept ones of the blocks before. Soft counts are
kept sparse, so that a key costs as much as the languages seen under it. A page
holds one number a language, and the driver the languages' names and shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .lexing import slices, text_bytes
from .skew import join_back

BUCKETS = 1 << 14
LANGUAGES = 64
CELLS = 1 << 20
_SKIPPED = re.compile(rb"(?i)(script|style|template|noscript)\b")
_END = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style", b"template", b"noscript")} | {b"!--": re.compile(rb"-->")}
_DECLARED = r"(?i)<html[^<>]*?\slang\s*=\s*[\"']?([a-z]{2,3})"


def trigram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams (A-Z lower-cased) for each text."""
    data, offsets = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    rows = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((rows, BUCKETS), np.float32)
    code = (data[:-2] * 1_000_003 + data[1:-1] * 8191 + data[2:] * 131) % BUCKETS
    row = np.repeat(np.arange(rows), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return np.bincount(row[:-2][inside] * BUCKETS + code[inside], minlength=rows * BUCKETS).reshape(rows, BUCKETS)


def train_text(docs: DataFrame, sample: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """All languages, sorted, and a table (lang, at, n) of their trigram counts from at most ``sample`` documents of each."""
    source = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and id is not null").withColumn("tie", F.xxhash64("text"))
    named = source.select("id", "tie", "lang").distinct()
    sizes = keep(named.groupBy("lang").agg(F.count(F.lit(1)).alias("m")), "languages")
    langs = sorted(sizes.select("lang").toArrow().column("lang").to_pylist())
    # the least hashes of a large language lie in a share of the range that holds about twice as many rows: only they are ranked
    share = (F.xxhash64("id", "tie").cast("double") + 2.0**63) / 2.0**64
    low = named.join(sizes, "lang").filter(share * F.col("m") <= 2 * sample + 1000).withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id", "tie"), "id", "tie")))
    ids = keep(low.filter(F.col("place") <= sample).select("id", "tie", "lang"), "sample")
    chosen = source.join(ids, ["id", "tie", "lang"]).dropDuplicates(["id", "tie", "lang"]).select("lang", "text")

    def rows(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, 64):
                    few = part.slice(at, 64)
                    for lang, n in zip(few.column("lang").to_pylist(), trigram_counts(few.column("text"))):
                        total[lang] = total.get(lang, 0) + n.astype(np.int64)
                    if len(total) > LANGUAGES:
                        yield from rows(total)
                        total = {}
        yield from rows(total)

    parts = chosen.mapInArrow(count, "lang string, at int, n long")
    return langs, keep(parts.groupBy("lang", "at").agg(F.sum("n").alias("n")), "trigrams")


def text_table(langs: list[str], trigrams: DataFrame) -> np.ndarray:
    """Log trigram shares (languages x BUCKETS) of one block of languages."""
    rows = trigrams.filter(F.col("lang").isin(langs)).toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    total = np.full((len(langs), BUCKETS), 0.5)
    total[np.array([place[v] for v in rows.column("lang").to_pylist()], np.int64), rows.column("at").to_numpy()] += rows.column("n").to_numpy()
    return np.log(total / total.sum(axis=1, keepdims=True))


def page_text(html: str) -> str:
    """The page with a space for each tag, comment, and script or the like with its content; one pass, whatever is left open."""
    data = html.encode()
    out, at, open_for_good = [], 0, set()
    while (begin := data.find(b"<", at)) >= 0:
        name = _SKIPPED.match(data, begin + 1)
        kind = name[1].lower() if name else b"!--" if data.startswith(b"<!--", begin) else None
        end = None
        if kind and kind not in open_for_good:
            end = _END[kind].search(data, begin + 1 + len(kind))
            if end is None:
                open_for_good.add(kind)  # nothing closes it here or farther on
        stop = end.end() if end else data.find(b">", begin + 1) + 1
        if not stop:
            break
        out.append(data[at:begin])
        at = stop
    return b" ".join([*out, data[at:]]).decode()


def _softmax(logs: np.ndarray) -> np.ndarray:
    shares = np.exp(logs - logs.max(axis=1, keepdims=True))
    return shares / shares.sum(axis=1, keepdims=True)


def _weigh(table: np.ndarray, last: bool):
    """A kernel that appends the block's log-likelihoods to ``text_log``; the last block's turns the text into sparse posteriors."""

    def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return pa.array(rows, pa.list_(kind))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, 64):
                    few = part.slice(at, 64)
                    texts = pa.array([page_text(t) if t else "" for t in few.column("text").to_pylist()], pa.large_string())
                    n = trigram_counts(texts)
                    size = n.sum(axis=1, keepdims=True)
                    # neighbouring trigrams are not independent: the evidence of a text grows with the root of its length
                    new = n @ table.T / np.sqrt(np.maximum(size, 1))
                    logs = np.hstack([np.array(few.column("text_log").to_pylist(), np.float64).reshape(few.num_rows, -1), new])
                    kept = [few.column(c) for c in ("id", "host", "declared")] + [lists(list(logs), pa.float64())]
                    if not last:
                        yield pa.RecordBatch.from_arrays([*kept, few.column("text")], names=["id", "host", "declared", "text_log", "text"])
                        continue
                    parts = np.floor(_softmax(logs) * 1_000_000 + 0.5).astype(np.int64)
                    seen = [np.flatnonzero(p) for p in parts]
                    yield pa.RecordBatch.from_arrays([*kept, lists(seen, pa.int32()), lists([p[i] for p, i in zip(parts, seen)], pa.int64())], names=["id", "host", "declared", "text_log", "at", "part"])

    return weigh


def _read_pages(pages: DataFrame, langs: list[str], trigrams: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: id, host, suffix, domain, declared, the text's tempered log-likelihoods, and its posteriors in millionths (at, part)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))
    read = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), _DECLARED, 1)).alias("declared"), F.col(html_col).cast("string").alias("text"))
    read = read.withColumn("text_log", F.array().cast("array<double>"))
    kind = f"id {dict(read.dtypes)['id']}, host string, declared string, text_log array<double>"
    for begin in range(0, len(langs), LANGUAGES):
        last = begin + LANGUAGES >= len(langs)
        weigh = _weigh(text_table(langs[begin : begin + LANGUAGES], trigrams), last)
        read = read.mapInArrow(weigh, f"{kind}, at array<int>, part array<bigint>" if last else f"{kind}, text string")
        if not last:
            read = keep(read, "blocks")
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    return read.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)).withColumn("domain", F.when(parent == "", F.col("host")).otherwise(parent))


def _soft_counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sums of text posteriors in millionths for each key, as a list of (at, n)."""
    each = df.select(*keys, F.explode(F.arrays_zip("at", "part")).alias("e")).groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.part").alias("n"))
    return each.groupBy(*keys).agg(F.collect_list(F.struct("at", "n")).alias(name))


def _fuse(langs: list[str], everything: np.ndarray, strength: float):
    """A kernel that adds up the four kinds of evidence and names the best language."""
    share = (everything + 1) / (everything.sum() + len(langs))

    def dense(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(langs)))
        pairs = column.flatten()
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        out[row, pairs.field("at").to_numpy()] = pairs.field("n").to_numpy() / 1_000_000
        return out

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(langs))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                few = batch.slice(at, step)
                text = few.column("text_log").flatten().to_numpy().reshape(few.num_rows, -1)
                mark, end, host, upper = (dense(few.column(c)) for c in ("mark_n", "end_n", "host_n", "domain_n"))
                upper = (upper + strength * share) / (upper.sum(axis=1, keepdims=True) + strength)
                host = np.log((host + strength * upper) / (host.sum(axis=1, keepdims=True) + strength))
                post = _softmax(text + np.log((mark + 0.5) / (everything + 5)) + np.log((end + 0.5) / (everything + 5)) + host)
                best = [pa.array([langs[i] for i in p.argmax(axis=1).tolist()], pa.string()) for p in (_softmax(text), post)]
                yield pa.RecordBatch.from_arrays([*(few.column(c) for c in ("id", "host", "declared", "suffix")), *best, pa.array(post.max(axis=1))], names=["id", "host", "declared", "suffix", "text_lang", "lang", "probability"])

    return fuse


def identify(pages: DataFrame, docs: DataFrame, sample: int = 1500, strength: float = 4.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id_col, host, declared, suffix, text_lang, lang, probability."""
    langs, trigrams = train_text(docs, sample)
    if not langs:
        return pages.select(F.col(id_col), *(F.lit(None).cast("string").alias(c) for c in ("host", "declared", "suffix", "text_lang", "lang")), F.lit(None).cast("double").alias("probability"))
    read = keep(_read_pages(pages, langs, trigrams, id_col, url_col, html_col), "pages")
    everything = np.zeros(len(langs))
    for r in read.select(F.explode(F.arrays_zip("at", "part")).alias("e")).groupBy(F.col("e.at").alias("at")).agg(F.sum("e.part").alias("n")).collect():
        everything[r["at"]] = r.n / 1_000_000
    marks, ends = _soft_counts(read, ["declared"], "mark_n"), _soft_counts(read, ["suffix"], "end_n")
    hosts = join_back(_soft_counts(read, ["host", "domain"], "host_n"), _soft_counts(read, ["domain"], "domain_n"), "domain").select("host", "host_n", "domain_n")
    met = join_back(join_back(join_back(read, marks, "declared"), ends, "suffix"), hosts, "host")
    joined = met.select("id", "host", "declared", "suffix", "text_log", "mark_n", "end_n", "host_n", "domain_n")
    kind = dict(joined.dtypes)["id"]
    out = joined.mapInArrow(_fuse(langs, everything, strength), f"id {kind}, host string, declared string, suffix string, text_lang string, lang string, probability double")
    return out.select(F.col("id").alias(id_col), "host", "declared", "suffix", "text_lang", "lang", F.round("probability", 6).alias("probability"))
