"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.sources.sinks import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # host, path prefix (from its slash on), allow or block

FEATURES = [
    "url_len", "host_len", "path_len", "host_depth", "path_depth", "digit_share", "host_digit_share", "hyphens",
    "n_params", "has_fragment", "is_https", "host_entropy", "path_entropy", "longest_label", "vowel_share",
    "suffix_rate", "suffix2_rate", "first_dir_rate",
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (its text, its verdict), else null: a rule fits its host and all subdomains when the
    path starts with the rule's. Equally long rules: the alphabetically first, block before allow."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]], r[2] == "block"))
    for h, p, v in order:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)

    def share(c: Column) -> Column:
        return F.size(F.filter(chars, lambda x: x == c)) / n

    return F.when(n > 0, F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def lexical_features(df: DataFrame, url: str) -> DataFrame:
    """df with _host, _path, suffix keys and the lexical features of the url (null: as an empty one)."""
    u = F.coalesce(F.col(url), F.lit(""))
    df = df.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    h, p = F.col("__host"), F.col("__path")
    labels, dirs = F.split(h, r"\."), F.split(p, "/")
    query = F.regexp_extract(_after(u), r"^[^?#]*\?([^#]*)", 1)
    numbers = {
        "url_len": F.length(u), "host_len": F.length(h), "path_len": F.length(p),
        "host_depth": F.when(h == "", 0).otherwise(F.size(labels)), "path_depth": _count(p, "/"),
        "digit_share": _share(_count(u, "0123456789"), F.length(u)),
        "host_digit_share": _share(_count(h, "0123456789"), F.length(h)), "hyphens": _count(h, "-"),
        "n_params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "has_fragment": F.contains(u, F.lit("#")).cast("int"),
        "is_https": F.lower(u).startswith("https://").cast("int"),
        "host_entropy": _entropy(h), "path_entropy": _entropy(p),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        "vowel_share": _share(_count(h, "aeiou"), F.length(h)),
    }
    keys = {
        "__suffix": F.substring_index(h, ".", -1), "__suffix2": F.substring_index(h, ".", -2),
        "__dir": F.coalesce(F.get(dirs, F.lit(1)), F.lit("")),
    }
    return df.withColumns({k: v.cast("double") for k, v in numbers.items()} | keys)


class UrlModel:
    """Boosted trees and the suffix statistics they were trained with."""

    def __init__(self, trees, rates: dict[str, DataFrame], base: float):
        self.trees, self.rates, self.base = trees, rates, base

    def block_score(self, df: DataFrame) -> DataFrame:
        """df (with lexical features) with `block_score`; a suffix not seen in training has the overall rate."""
        for key, rate in self.rates.items():
            df = df.join(rate, key, "left").fillna({_rate_name(key): self.base})
        if self.trees is None:
            return df.withColumn("block_score", F.lit(self.base))
        df = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(df)
        df = self.trees.transform(df)
        return df.withColumn("block_score", F.element_at(vector_to_array("__p"), 2))


def _rate_name(key: str) -> str:
    return {"__suffix": "suffix_rate", "__suffix2": "suffix2_rate", "__dir": "first_dir_rate"}[key]


def train(
    labelled: DataFrame, url: str = "url", label: str = "blocked", sample_rows: int = 20_000, trees: int = 20,
    depth: int = 4, prior_weight: float = 20.0, seed: int = 11,
) -> UrlModel:
    """Fit boosted trees on labelled urls (label 1: block, 0: allow; null labels are left out).

    Suffix statistics (last label, last two labels, first path step) are block rates over all labelled urls, drawn
    to the overall rate by `prior_weight` urls. The trees are fitted to at most about `sample_rows` urls with
    distinct (url, label), chosen by a hash; this bound is the only one, and does not grow with the table. No
    labelled url, or one class only: no trees, every url has the overall rate (0 without labels).
    """
    rows = settle(lexical_features(
        labelled.where(F.col(label).isNotNull()).select(F.col(url), F.col(label).cast("double").alias("__y")), url))
    total = rows.agg(F.count("*").alias("n"), F.sum("__y").alias("s")).first()
    n, s = total["n"], total["s"] or 0.0
    base = s / n if n else 0.0
    if not n or s in (0.0, float(n)):
        return UrlModel(None, {}, base)
    rates = {
        key: settle(rows.groupBy(key).agg(
            ((F.sum("__y") + prior_weight * base) / (F.count("*") + prior_weight)).alias(_rate_name(key))))
        for key in ("__suffix", "__suffix2", "__dir")}
    model = UrlModel(None, rates, base)
    share = min(1.0, sample_rows / n)
    rank = F.pmod(F.xxhash64(F.lit(seed), url, "__y"), F.lit(1 << 30))
    sample = rows.where(rank < int(share * (1 << 30))) if share < 1 else rows
    sample = sample.dropDuplicates([url, "__y"])
    for key, rate in rates.items():
        sample = sample.join(rate, key, "left")
    sample = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(sample).select("__x", "__y")
    if sample.select("__y").distinct().count() < 2:
        return model
    booster = GBTClassifier(
        featuresCol="__x", labelCol="__y", predictionCol="__d", maxIter=trees, maxDepth=depth, seed=seed)
    model.trees = booster.setRawPredictionCol("__raw").setProbabilityCol("__p").fit(settle(sample))
    return model


def judge(
    df: DataFrame, model: UrlModel, rules: Sequence[Rule] = (), url: str = "url", threshold: float = 0.5,
) -> DataFrame:
    """df with host, path, rule, verdict (allow or block), block_score.

    verdict: that of the longest rule that fits, else block where block_score > threshold. A null url, or one
    without ://, has empty host and path and is scored on these. Clashing columns of df are replaced.
    """
    made = ["host", "path", "rule", "verdict", "block_score", *FEATURES]
    rows = lexical_features(df.drop(*[c for c in made if c != url]), url)
    text, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    rows = model.block_score(rows.withColumn("rule", text).withColumn("__verdict", verdict))
    scored = F.when(F.col("block_score") > threshold, "block").otherwise("allow")
    keep = [c for c in df.columns if c not in made or c == url]
    return rows.select(
        *keep, F.col("__host").alias("host"), F.col("__path").alias("path"), "rule",
        F.coalesce("__verdict", scored).alias("verdict"), "block_score")
