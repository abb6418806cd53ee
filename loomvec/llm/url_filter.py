"""URL filter: host and path rules, then a character language-model ratio.

Rules are (host, path prefix, verdict); a rule fits its host and all subdomains,
and the longest written rule wins. URLs that rules accept and URLs that rules
reject train two variable-order Markov models over characters. A character is
predicted from up to ``order`` before it, with Witten-Bell smoothing down to
shorter contexts and at last a uniform one. A URL without a rule is judged by the
difference of its two log-likelihoods, divided by its length, against a bound
calibrated half-way between the two classes' means.

Everything is DataFrame expressions. Different grams of all URLs are counted once
with map-side combine; every length of context is a grouped aggregate of these
counts, joined to the next shorter one, so that each gram has the ratio of its
longest known part before the characters of the URLs meet it. The model is a
table that grows with the input. Spark would choose what to broadcast by the size
of compressed files, of which the characters of all URLs are a multiple; joins
therefore broadcast counted tables of at most FEW rows and merge all others, and
a gram of most URLs is split by adaptive execution. Log ratios are rounded to whole
millionths and summed as integers, so results do not depend on the order of rows.

Null URLs and URLs without ``://`` have empty host and path and no rule; their
text (null: empty) is still judged by the models. Empty text is allowed. Very
long URLs are taken whole, in time proportional to their length. Of rules that fit, no two have one length and differ
unless they name different hosts; then the later one by name wins. A ratio equal
to the bound is allowed. Repeated rows and ids get a row each. If either class
has no URL, every URL without a rule is allowed. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep

Rule = tuple[str, str, str]
#: Every rule as it is written, its host, its path prefix and its verdict.
DEFAULT_RULES: tuple[Rule, ...] = (("com/", "allow", "com"), ("example.com/en/", "block", "example.com"), ("www.example.com/en/", "allow", "www.example.com"), ("net/es/", "block", "net"), ("net/fr/", "block", "net"))
ORDER = 5
#: Code points, the uniform distribution's support.
SYMBOLS = 1_114_112
SCALE = 1_000_000
#: Characters of a URL that are taken at once; more than any ``order``.
PIECE = 256
#: Rows of a table of grams up to which a join broadcasts it.
FEW = 1 << 16


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/?#``, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict, name in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(rule[len(name) :])
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def padded(url: Column, order: int = ORDER) -> Column:
    """The URL, A-Z lower-cased, null as empty, behind ``order`` marks of the start."""
    return F.concat(F.lit("^" * order), F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _grams(df: DataFrame, name: str, order: int) -> DataFrame:
    """One row for each character, with those before it; rows of empty texts vanish.

    A text is cut in one pass into pieces of PIECE characters, each behind the ``order`` characters before it, so that no place of
    a long text is counted off from its beginning.
    """
    body = F.substring("text", F.lit(order + 1), F.length("text"))
    cut = df.select(name, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    before = lambda i: F.when(i == 0, F.lit("^" * order)).otherwise(F.right(F.get("pieces", i - 1), F.lit(order)))
    pieces = cut.select(name, F.explode(F.transform("pieces", lambda piece, i: F.concat(before(i), piece))).alias("piece"))
    places = pieces.select(name, "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - order)).alias("at"))
    return places.select(name, F.substring("piece", F.col("at"), F.lit(order + 1)).alias("gram"))


def _end(column: str, n: int) -> Column:
    return F.right(F.col(column), F.lit(n))


def _match(left: DataFrame, kept: DataFrame, on: str) -> DataFrame:
    """Inner join to a kept table. Its rows are counted, since a compressed file's size says little about them; above FEW nothing is broadcast."""
    return left.join(kept.hint("broadcast" if kept.count() <= FEW else "merge"), on)


def learn(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, micro): for each different gram the log-likelihood ratio, in millionths, of its longest end seen in training, 0 without one.

    ``grams`` has the different grams of ``order`` + 1 characters and how often each class shows them (a, b). Level after level, from one
    character on, every end of a gram gets its smoothed chances and its ratio; an end not seen in training takes the shorter one's ratio.
    """
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))

    def smooth(count: str, total: str, different: str, lower: Column) -> Column:
        """Witten-Bell: the share of the context's count, and of its kinds for the shorter context."""
        weight = F.col(total) + F.col(different)
        return F.when(weight > 0, (F.col(count) + F.col(different) * lower) / weight).otherwise(lower)

    level = None
    for n in range(1, order + 2):
        counts = grams.groupBy(_end("gram", n).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("context", F.left(F.col("g"), F.lit(n - 1)))
        contexts = counts.groupBy("context").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), kinds("a").alias("ka"), kinds("b").alias("kb"))
        here, lower = counts.join(contexts.hint("merge"), "context"), (F.lit(1.0 / SYMBOLS), F.lit(1.0 / SYMBOLS), F.lit(0).cast("long"))
        if level is not None:
            shorter = level.select(F.col("g").alias("rest"), F.col("pa").alias("la"), F.col("pb").alias("lb"), F.col("micro").alias("ratio"))
            here, lower = _match(here.withColumn("rest", _end("g", n - 1)), shorter, "rest"), (F.col("la"), F.col("lb"), F.col("ratio"))
        chances = here.select("g", smooth("a", "ta", "ka", lower[0]).alias("pa"), smooth("b", "tb", "kb", lower[1]).alias("pb"), (F.col("a") + F.col("b") > 0).alias("seen"), lower[2].alias("ratio"))
        micro = F.when(F.col("seen"), F.floor((F.log("pa") - F.log("pb")) * SCALE).cast("long")).otherwise(F.col("ratio"))
        level = keep(chances.select("g", "pa", "pb", micro.alias("micro")), "url-model")
    return level.select("g", "micro")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id_col, host, path, rule, verdict, ratio (mean log ratio in millionths; null where a rule decided)."""
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), padded(url, order).alias("text"))
    # the row number is written with the row, so a repeated task cannot number rows anew
    parsed = keep(parsed.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("uid", F.monotonically_increasing_id()), "urls")

    verdicts = parsed.select("text", F.col("fit.verdict").alias("verdict"))
    grams = _grams(verdicts, "verdict", order).groupBy("gram").agg(*(F.sum(F.coalesce((F.col("verdict") == v).cast("long"), F.lit(0))).alias(v[0]) for v in ("allow", "block")))
    grams = keep(grams, "url-grams")
    known = learn(grams, order).withColumnRenamed("g", "gram")
    ratios = _match(_grams(parsed, "uid", order), known, "gram").groupBy("uid").agg(F.floor(F.sum("micro") / F.count(F.lit(1))).cast("long").alias("ratio"))
    rated = keep(parsed.drop("text").join(ratios.hint("merge"), "uid", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0))), "rated")

    means = rated.agg(*(F.avg(F.when(F.col("fit.verdict") == v, F.col("ratio"))).alias(v[0]) for v in ("allow", "block")))
    rated = rated.join(F.broadcast(means.select(((F.col("a") + F.col("b")) / 2).alias("bound"))))
    by_model = F.when(F.coalesce(F.col("ratio") >= F.col("bound"), F.lit(True)), "allow").otherwise("block")
    return rated.select(F.col("id").alias(id_col), "host", "path", "fit.rule", F.coalesce("fit.verdict", by_model).alias("verdict"), F.when(F.isnull("fit"), F.col("ratio")).alias("ratio"))
