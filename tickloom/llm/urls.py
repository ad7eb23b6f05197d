"""Verdicts on URLs: host and path rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.workdir import written

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as its text; null if none does."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one asked first
        of_host = (host == r.host) | host.endswith("." + r.host)
        found = F.when(of_host & path.startswith(r.path), r.text).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character of the characters' distribution; 0 for an empty text."""
    chars = F.split(text, "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(text == "", 0.0).otherwise(bits)


def count_of(text: Column, what: str) -> Column:
    """How often a one-character string occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "fragment",
    "hyphens", "secure", "suffix_rate", "suffix_log_n",
)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the feature columns that need the url alone. ``host`` and ``path`` must be there."""
    text = F.coalesce(F.col(url), F.lit(""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": F.length(text).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count_of(F.col("path"), "/"),
            "labels": count_of(F.col("host"), "."),
            "digits": digits / F.greatest(F.length(text), F.lit(1)),
            "entropy": entropy(text),
            "parameters": F.when(query == "", 0.0).otherwise(count_of(query, "&") + 1),
            "fragment": F.contains(text, F.lit("#")).cast("double"),
            "hyphens": count_of(text, "-"),
            "secure": text.startswith("https").cast("double"),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Per host suffix: how many of the different labelled urls there are, and how many of them are blocked."""
    return labelled.groupBy("suffix").agg(F.count("*").alias("suffix_n"), F.sum("label").alias("suffix_blocked"))


def with_suffix(urls: DataFrame, statistics: DataFrame, strength: float = 20.0) -> DataFrame:
    """Adds the suffix's share of blocked urls, drawn to one half, and their number; a labelled url's own label apart."""
    known = urls.join(statistics, "suffix", "left")
    own = F.col("label").isNotNull().cast("double")
    n = F.coalesce("suffix_n", F.lit(0)) - own
    blocked = F.coalesce("suffix_blocked", F.lit(0.0)) - F.coalesce("label", F.lit(0.0))
    return known.withColumns({"suffix_rate": (blocked + strength / 2) / (n + strength), "suffix_log_n": F.log1p(n)})


def training_sample(labelled: DataFrame, urls: int, most: int) -> DataFrame:
    """``most`` of the ``urls`` different labelled urls (or all), those with the smallest hashes."""
    parts = 1 << 30
    # twice as many are let through first, so that no task has to sort more than that
    share = min(parts, int(2 * most / max(urls, 1) * parts) + 1)
    near = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(parts)) < share)
    return near.orderBy(F.pmod(F.xxhash64("url"), F.lit(parts)), "url").limit(most)


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    train_urls: int = 20_000,
    trees: int = 10,
    depth: int = 4,
) -> DataFrame:
    """One row per page: host, path, the rule that fits and the verdict; ``score`` is the trees' chance of a block.

    The urls that a rule decides are the labelled ones. Suffix statistics are
    taken over all different ones of them, and a url's own label is left out of
    its suffix's. The trees are fitted on at most ``train_urls`` different ones,
    picked by a hash of the url and weighted by the number of their rows, and
    judge the urls without a rule. All of it is DataFrame operations.

    A null or empty url, or one without ``://``, has empty host and path and no
    rule; the trees judge it like others. Repeated rows stay. If all labels are
    alike, that is the verdict for the rest; without any label it is allow.
    Other columns are left out, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    urls = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .withColumns({"host": host, "path": path})
        .withColumn("rule", match(rules, F.col("host"), F.col("path")))
        .withColumn("suffix", suffix(F.col("host")))
    )
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else None
    said = F.element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string")
    urls = urls.withColumn("said", said).withColumn("label", (F.col("said") == BLOCK).cast("double"))
    labelled = urls.filter("label is not null").groupBy("url", "host", "path", "suffix", "label")
    labelled = written(labelled.agg(F.count("*").cast("double").alias("rows")), "labelled-urls")
    counted = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(counted) < 2:
        rest = BLOCK if 1.0 in counted else ALLOW
        return urls.select(
            *out, F.coalesce("said", F.lit(rest)).alias("verdict"), F.lit(float(rest == BLOCK)).alias("score")
        )
    statistics = suffix_statistics(labelled)
    chosen = training_sample(labelled, sum(counted.values()), train_urls)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees_ = GBTClassifier(labelCol="label", weightCol="rows", maxIter=trees, maxDepth=depth, maxBins=32, seed=7)
    rows = with_suffix(lexical(chosen), statistics).select("label", "rows", *FEATURES)
    model = trees_.fit(assembler.transform(rows.coalesce(8)))
    model.setProbabilityCol("chances").setRawPredictionCol("raw").setPredictionCol("guess")
    score = vector_to_array("chances")[1]
    full = with_suffix(lexical(urls), statistics)
    return model.transform(assembler.transform(full)).select(
        *out,
        F.coalesce("said", F.when(score >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        score.alias("score"),
    )
