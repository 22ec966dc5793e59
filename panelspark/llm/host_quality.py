"""Quality rules of documents, and verdicts on whole hosts from shrunk failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.sources.sinks import settle

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words_col: str, n: int = REPEAT_WINDOW) -> Column:
    """Words inside n-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' hashes. Sorting windows is done only for texts that
    have an equal pair.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def equal_next(order: Column) -> Column:
        """Starts of windows that equal a neighbour in the sorted order, ascending."""
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))

        twice = F.transform(order, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def spread(starts: Column) -> Column:
        """Words under windows with these starts: each adds up to the next start, n at most."""
        gaps = F.transform(starts, lambda s, j: F.least(F.lit(n), F.coalesce(F.get(starts, j + 1) - s, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(order, lambda o: _let(equal_next(o), spread))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(0)

    hashed = F.transform(words_col, lambda x: F.xxhash64(x))
    return F.when(
        F.size(words_col) > n, _let(hashed, lambda h: _let(windows(h), count))).otherwise(0).cast("long")


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def document_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. Null text: no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    out = df.withColumn("__words", words(F.col(text)))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words("__words"),
    }).drop("__words")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (
        100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_verdicts(
    docs: DataFrame, host: str = "host", failed: str = "failed", max_rate: float = 0.5,
) -> DataFrame:
    """One row per host: n_docs, n_failed, shrunk_rate and host_ok.

    The failure rates of hosts are shrunk by a beta prior fitted to all hosts by moments (each host's documents
    as binomial draws): shrunk_rate = (failures + a) / (documents + a + b). A host is rejected when the shrunk rate
    exceeds max_rate. One host, or rates that vary no more than chance: the prior is the overall rate with the
    weight of all documents, so no host stands out. No documents: no rows.
    """
    hosts = docs.groupBy(host).agg(
        F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    hosts = settle(hosts)
    n, p = F.col("n_docs"), F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(
        F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
        F.sum(n * n).alias("nn"), F.sum(n * p * p).alias("pp")).first()  # five numbers
    a, b = beta_prior(m["k"] or 0, m["n"] or 0, m["f"] or 0, m["nn"] or 0, m["pp"] or 0.0)
    rate = (F.col("n_failed") + F.lit(a)) / (n + F.lit(a + b))
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_ok", F.col("shrunk_rate") <= max_rate)


def beta_prior(k: int, n: int, f: int, nn: float, pp: float) -> tuple[float, float]:
    """Moment fit of a beta-binomial: k hosts, n documents, f failures, sum of n_i^2, sum of n_i p_i^2."""
    if n == 0:
        return 1.0, 1.0
    mean = (f + 0.5) / (n + 1.0)
    if k < 2:
        return mean * n, (1 - mean) * n
    spread = pp - n * (f / n) ** 2  # sum n_i (p_i - p)^2
    within = mean * (1 - mean)
    scale = n - nn / n
    between = (spread - (k - 1) * within) / scale if scale > 0 else 0.0
    weight = within / between - 1 if between > within / (n + 1.0) else float(n)
    weight = min(max(weight, 1e-3), float(n))
    return mean * weight, (1 - mean) * weight


def judge(
    df: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, max_symbol_share: float = 0.3,
    max_dup_line_words: float = 0.5,
) -> DataFrame:
    """df's columns with the rules' counts, base_failed, failed, host verdict columns and `kept`.

    A document fails when base_failed, when symbols exceed `max_symbol_share` of its word characters, or when more
    than `max_dup_line_words` of its lines repeat an earlier one. kept: not base_failed, and its host's shrunk
    failure rate is at most max_rate. A null host is a host of its own. Columns that clash with results are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "n_docs",
            "n_failed", "shrunk_rate", "host_ok", "kept"]
    # replaced columns are dropped first, unless they hold the text or the host
    base = df.drop(*[c for c in made if c not in (text, host)])
    n_lines = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    ruled = document_rules(base.withColumn("__n_lines", n_lines), text)
    ruled = ruled.withColumn("failed", F.col("base_failed") | (
        F.col("n_symbols") > max_symbol_share * F.col("word_chars")) | (
        F.col("n_dup_lines") > max_dup_line_words * F.col("__n_lines"))).drop("__n_lines")
    ruled = settle(ruled)
    hosts = host_verdicts(ruled.select(F.col(host).alias("__host"), "failed"), "__host", "failed", max_rate)
    out = ruled.join(hosts, ruled[host].eqNullSafe(hosts["__host"]), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
