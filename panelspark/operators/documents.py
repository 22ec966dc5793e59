"""Corpus jobs: attach, compare and scrub dated documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.sinks import settle
from .joins import previous_record


def newest(hits: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int, out: str = "pos") -> DataFrame:
    """The n newest rows per key, numbered from old to new. The bound is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    top = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie))).drop("_rn")


def attach_documents(
    points: DataFrame, docs: DataFrame, key: str, t: str, annual: str, quarterly: str, event: str,
    section: Column, event_chars: int | None = None, n_events: int = 5, months: int = 6,
) -> DataFrame:
    """Latest annual and quarterly document and the newest events of the trailing window, per decision.

    Only ids travel through the as-of and interval joins; only texts of chosen documents are cut and joined to the
    ids at the end. Events come whole, or with `event_chars` as their first so many characters. Documents without text are dropped before the newest are chosen.
    `section` gives the excerpt of an annual or quarterly text.
    """
    from .joins import asof_join, interval_join

    have = docs.where(F.col("text").isNotNull())
    ids = have.select(key, "form", "filed", "doc_id")
    out = points.select(key, t).distinct()
    for form, name in ((annual, "annual_id"), (quarterly, "quarterly_id")):
        f = ids.where(F.col("form") == form).select(key, "filed", F.col("doc_id").alias(name))
        out = asof_join(out, f, [key], t, "filed", [name], [name]).drop("filed")
    hits = interval_join(points.select(key, t).distinct(), ids.where(F.col("form") == event).drop("form"), [key], t, "filed", months_back=months)
    top = newest(hits, [key, t], "filed", "doc_id", n_events).select(key, t, "doc_id", F.col("pos").alias("slot"))
    wanted = out.select(key, t, F.explode(F.array(
        F.struct(F.col("annual_id").alias("doc_id"), F.lit(-1).alias("slot")), F.struct(F.col("quarterly_id").alias("doc_id"), F.lit(0).alias("slot")),
    )).alias("_w")).select(key, t, "_w.*").where(F.col("doc_id").isNotNull()).unionByName(top)
    event_text = F.col("text") if event_chars is None else F.substring("text", 1, event_chars)
    parts = have.select("doc_id", "form", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.when(F.col("form") == event, event_text).otherwise(section).alias("part"))
    full = wanted.join(parts, "doc_id").select(key, t, "slot", "doc_id", "part")
    # at most n_events + 2 parts per decision
    blob = full.groupBy(key, t).agg(
        F.sort_array(F.collect_list(F.struct("slot", "doc_id", "part"))).alias("_p"))
    return out.join(blob, [key, t], "left").select(
        key, t, "annual_id", "quarterly_id",
        F.size(F.filter(F.coalesce("_p", F.array().cast("array<struct<slot:int,doc_id:bigint,part:string>>")), lambda p: p["slot"] > 0)).alias("n_events"),
        F.array_join(F.transform("_p", lambda p: p["part"]), "\n").alias("text"),
    )


def recency_audit(points: DataFrame, docs: DataFrame, key: str, t: str, ts: str, months: int, keep: int) -> DataFrame:
    """Documents in the trailing window, how many a keep-the-oldest cut keeps and drops, and the distinct
    dates of the dropped ones. Counted per day, so a decision never gathers more than the window's days."""
    from .joins import interval_join

    days = docs.groupBy(key, ts).agg(F.count("*").alias("_c"))
    hits = interval_join(points.select(key, t).distinct(), days, [key], t, ts, months_back=months)
    w = Window.partitionBy(key, t).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_cum", F.sum("_c").over(w))
    g = hits.groupBy(key, t).agg(
        F.sum("_c").alias("n_window"), F.sort_array(F.collect_list(F.when(F.col("_cum") > keep, F.col(ts)))).alias("_d"))
    full = points.select(key, t).distinct().join(g, [key, t], "left")
    n = F.coalesce("n_window", F.lit(0))
    return full.select(
        key, t, n.alias("n_window"), F.least(n, F.lit(keep)).alias("n_kept"), F.greatest(n - keep, F.lit(0)).alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("_d", lambda d: d.cast("string")), ";"), F.lit("")).alias("dropped_dates"), (n > keep).alias("affected"))


TOKEN = r"[\p{L}\p{N}_]{2,}"


CHARS = 8_000_000  # of texts whose terms a task of text_change counts, about


def text_change(docs: DataFrame, key: Sequence[str], ts: str, doc: str, text: str, min_chars: int = 0, stop_words: Sequence[str] = ()) -> DataFrame:
    """TF-IDF cosine of each document with the previous one of its key.

    Pair weights use the two-document smoothed idf ln(3 / (1 + df)) + 1. A text moves by its id to the (at most two) pairs it
    is in, then to each of them; the terms of a pair are counted and compared where its texts meet and never move. The
    number of partitions follows from the counted characters. A pair without a common weight (a text without terms)
    has NULL similarity.
    """
    size = docs.withColumn("_len", F.length(text))
    prev = previous_record(size.select(*key, ts, doc, "_len"), key, ts, doc, ["_len"])
    pairs = settle(prev.where((F.col("_len") >= min_chars) & (F.col("prev__len") >= min_chars)).select(
        F.col(doc).alias("_cur"), F.col(f"prev_{doc}").alias("_prev"), (F.col("_len") + F.col("prev__len")).alias("_chars")))
    n = -(-(pairs.agg(F.sum("_chars")).first()[0] or 0) // CHARS) or 1
    side = lambda c, pair, cur: F.struct(F.col(c).alias(doc), F.col(pair).alias("_pair"), F.lit(cur).alias("_cur_side"))
    sides = pairs.select(F.explode(F.array(side("_cur", "_cur", 1), side("_prev", "_cur", 0))).alias("_s")).select("_s.*")
    sides = sides.groupBy(doc).agg(F.collect_list(F.struct("_pair", "_cur_side")).alias("_in"))
    met = docs.select(doc, text).repartition(n, doc).join(sides, doc).select(text, F.explode("_in").alias("_s")).select(text, "_s.*").repartition(n, "_pair")
    words = met.select("_pair", "_cur_side", F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("_term"))
    if stop_words:
        words = words.where(~F.col("_term").isin(*stop_words))
    count = lambda cur: F.nullif(F.sum(F.when(F.col("_cur_side") == cur, 1.0).otherwise(0.0)), F.lit(0.0))
    both = words.groupBy("_pair", "_term").agg(count(1).alias("_a"), count(0).alias("_b"))
    idf = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    a, b = F.coalesce("_a", F.lit(0.0)) * idf, F.coalesce("_b", F.lit(0.0)) * idf
    g = both.groupBy("_pair").agg(F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"))
    cos = F.col("_ab") / F.nullif(F.sqrt(F.col("_aa") * F.col("_bb")), F.lit(0.0))
    return pairs.join(g, F.col("_cur") == F.col("_pair"), "left").select(
        F.col("_cur").alias(doc), F.col("_prev").alias(f"prev_{doc}"), cos.alias("similarity"), (1 - cos).alias("changed"))


def forward_totals(points: DataFrame, outcomes: DataFrame, key: Sequence[str], t: str, ts: str, values: dict[str, Column], months: int) -> DataFrame:
    """Sums of outcomes in (t, t + months] per point, as a difference of two as-of running totals.

    No pair of a point and an outcome is formed; every window sees one row per key and day.
    """
    from .joins import asof_join

    key, names = list(key), list(values)
    day = outcomes.groupBy(*key, F.col(ts).alias("_day")).agg(*[F.sum(c).alias(n) for n, c in values.items()])
    w = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    run = day.select(*key, "_day", *[F.sum(F.coalesce(n, F.lit(0))).over(w).alias(n) for n in names])
    p = points.select(*key, t).distinct().withColumn("_end", F.add_months(t, months))
    lo = asof_join(p, run.withColumnsRenamed({n: f"_lo_{n}" for n in names}), key, t, "_day", [f"_lo_{n}" for n in names], [f"_lo_{n}" for n in names]).drop("_day")
    hi = asof_join(lo, run.withColumnsRenamed({n: f"_hi_{n}" for n in names}), key, "_end", "_day", [f"_hi_{n}" for n in names], [f"_hi_{n}" for n in names]).drop("_day")
    sums = hi.select(*key, t, *[(F.coalesce(f"_hi_{n}", F.lit(0)) - F.coalesce(f"_lo_{n}", F.lit(0))).alias(n) for n in names])
    return points.join(sums, [*key, t], "left")


def alias_patterns(aliases: DataFrame, key: str, alias: str) -> DataFrame:
    """One case-insensitive pattern per entity from its (short) list of names, longest first."""
    quoted = F.regexp_replace(alias, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    names = F.sort_array(F.collect_set(F.struct(F.length(alias).alias("n"), quoted.alias("a"))), asc=False)
    g = aliases.where(F.length(alias) > 0).groupBy(key).agg(names.alias("_n"))
    body = F.array_join(F.transform("_n", lambda x: x["a"]), "|")
    return g.select(key, F.concat(F.lit("(?i)(?<![A-Za-z0-9])(?:"), body, F.lit(")(?![A-Za-z0-9])")).alias("pattern"))


#: What may stand between the words of a name, and what marks a symbol in other use than its own.
BETWEEN_WORDS = r"[\s\-–,\.]{0,3}"
SYMBOL_USES = (r"\.(?:com|net|org)\b", ":[A-Za-z]", "pr[A-Za-z]")


def identity_patterns(
    entities: DataFrame, key: str, symbol: str, names: str, generic: Sequence[str] = (), ambiguous: Sequence[str] = (), min_token: int = 4,
) -> DataFrame:
    """key, pattern: all forms that give an entity away, as one pattern with a case rule for each form.

    Forms, none of them inside a word: a name (an array of them is given) with any short separator between its words, also at
    the front of a longer word; each of its words of min_token letters that isn't generic; the symbol by itself, in any
    case unless it is a common word (`ambiguous`), then in its own; the symbol in any case as a domain, as the prefix of a tag,
    or before a class of shares. An entity without names has its symbol; one without either has no pattern.
    """
    quoted = F.regexp_replace(symbol, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    words = lambda x: F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda w: w != "")
    own = F.filter(F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))), lambda x: (F.upper(x) != F.coalesce(F.upper(symbol), F.lit(""))) & (F.size(words(x)) > 0))
    phrases = F.transform(F.array_sort(own, lambda a, b: F.length(b) - F.length(a)), lambda x: F.array_join(words(x), BETWEEN_WORDS))
    tokens = F.array_sort(F.filter(F.array_distinct(F.flatten(F.transform(own, lambda x: F.transform(words(x), F.lower)))),
                                   lambda w: (F.length(w) >= min_token) & ~w.isin(*[g.lower() for g in generic], "")))
    alone = F.when(F.col(symbol).isin(*ambiguous, ""), quoted).otherwise(F.concat(F.lit("(?i:"), quoted, F.lit(")")))
    some = lambda xs, end: F.when(F.size(xs) > 0, F.concat(F.lit("(?i:"), F.array_join(xs, "|"), F.lit(")" + end)))
    has_symbol = F.length(symbol) > 0
    forms = F.filter(F.array(
        some(phrases, ""), some(tokens, "(?![A-Za-z0-9])"), F.when(has_symbol, F.concat(alone, F.lit("(?![A-Za-z0-9])"))),
        F.when(has_symbol, F.concat(F.lit("(?i:"), quoted, F.lit(f"(?={'|'.join(SYMBOL_USES)}))")))), lambda x: x.isNotNull())
    whole = F.concat(F.lit("(?<![A-Za-z0-9])(?:"), F.array_join(forms, "|"), F.lit(")"))
    return entities.select(key, F.when(F.size(forms) > 0, whole).alias("pattern")).where(F.col("pattern").isNotNull())


#: Registry and filing numbers.
ID_PATTERNS = (r"\b\d{10}-\d{2}-\d{6}\b", r"\b\d{10}\b")


def scrub_identity(docs: DataFrame, patterns: DataFrame, key: str, text: str, mask: str = "[ENTITY]", out: str = "scrubbed") -> DataFrame:
    """Replace an entity's names and numeric identifiers in its own documents.

    Names are replaced twice: what follows a mask stands at the start of a word, and may be a form itself. Patterns are
    written first, so that their size is known before any text is moved to a key, of which there may be few.
    """
    j = docs.join(settle(patterns), key, "left")
    c = F.col(text)
    for _ in range(2):
        c = F.when(F.col("pattern").isNotNull(), F.regexp_replace(c, F.col("pattern"), F.lit(mask))).otherwise(c)
    for p in ID_PATTERNS:
        c = F.regexp_replace(c, p, "[ID]")
    return j.withColumn(out, c)


def leak_hits(df: DataFrame, text: str, out: str = "hits", fail: bool = False) -> DataFrame:
    """Identity matches left in each document; with `fail`, a document with any stops the job."""
    n = F.coalesce(F.regexp_count(F.col(text), F.col("pattern")), F.lit(0))
    for p in ID_PATTERNS:
        n = n + F.regexp_count(F.col(text), F.lit(p))
    if fail:
        n = F.when(n > 0, F.raise_error(F.lit("identity left in text")).cast("int")).otherwise(n)
    return df.withColumn(out, n)


def parse_worksheet(df: DataFrame, text: str, keep: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """`## n. NAME - date` sections with `dim ... = score` lines to (item, dim, score) rows."""
    head = r"(?m)^## \d+\.\s+([A-Z]+)\s+[-—]\s+(\d{4}-\d{2}-\d{2})"
    body = F.split(F.col(text), head)
    cells = F.arrays_zip(
        F.regexp_extract_all(F.col(text), F.lit(head), F.lit(1)).alias("name"),
        F.regexp_extract_all(F.col(text), F.lit(head), F.lit(2)).alias("day"),
        F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))).alias("chunk"),
    )
    items = df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")
    scores = F.array(*[
        F.struct(F.lit(d).alias("dim"), F.regexp_extract("chunk", rf"{d}[^=\n]*=\s*([012])", 1).try_cast("int").alias("score")) for d in dims
    ])
    return items.select(*keep, "name", F.col("day").cast("date").alias("day"), F.inline(scores))
