"""Text expressions on JVM regular expressions; whole texts, no Python."""

from __future__ import annotations

from html.entities import name2codepoint
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .columns import col

# Phrases and patterns whose wording decides the results.
RISK_TERMS = (
    "covenant", "default", "litigation", "lawsuit", "impairment", "bankrupt",
    "downgrade", "tenant", "vacancy", "vacanc", "lease termination", "going concern",
    "restructur", "dilution", "redemption", "refinanc", "maturity", "delinquen",
    "occupancy", "guidance cut", "dividend cut", "suspend", "write-down", "writedown",
)
NEGATIVE_WORDS = (
    "loss losses adverse adversely decline declined decrease decreased default deteriorate deteriorating "
    "impairment litigation lawsuit bankruptcy insolvency covenant breach downgrade weakness weaknesses risk "
    "risks volatile volatility vacancy delinquent delinquency restructuring writeoff write-down shortfall "
    "deficiency liabilities terminate termination unable failure failed concern doubt"
).split()
UNCERTAIN_WORDS = (
    "may might could uncertain uncertainty possible possibly approximately contingent depends dependent risk "
    "anticipate believe estimate assume potential"
).split()
DATE = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2})"
FILED_DATE = r"(?:filed|8-?K[^.]{0,12}?)\s*(?:on\s+)?" + DATE
MONEY = r"\$\s?\d[\d,.]*"
PERCENT = r"\d+\.\d+\s?%"
YEAR = r"\b(?:19|20)\d\d\b"
# Fixed value: the form of a named figure.
KEY_VALUE = r"^\s*([a-z_]+)\s*[:=]\s*(-?\d+\.?\d*)"
HAS_MONEY = r"\$\s?\d"
HAS_PERCENT = r"\d+(?:\.\d+)?\s?%"


def collapse_space(c) -> Column:
    """Any run of Unicode white space becomes one blank."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def letters_only(c, keep_space: bool = False) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z ]" if keep_space else "[^A-Za-z]+", " " if keep_space else "")


def truncate(c, n: int, marker: str) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def term_count(c, terms: Sequence[str]) -> Column:
    """How many of the terms occur at least once, in lower case."""
    low = F.lower(col(c))
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(low, F.lit(t)).cast("int")
    return total


def tokens(c, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def key_value(c) -> dict[str, Column]:
    """`name: number` at the start of a fact; names are in small letters."""
    return {
        "name": F.regexp_extract(col(c), KEY_VALUE, 1),
        "value": F.regexp_extract(col(c), KEY_VALUE, 2).try_cast("double"),
    }


def cited_dates(c, pattern: str = DATE) -> Column:
    """Dates in `yyyy-mm-dd` or `Month d, yyyy` form; unreadable ones are left out.

    The pattern's first group is the date. `FILED_DATE` takes only dates tagged as filing dates.
    """
    raw = F.regexp_extract_all(col(c), F.lit("(?i)" + pattern), F.lit(1))

    def parse(s):
        short = F.initcap(F.regexp_replace(s, r"^([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$", "$1 $2 $3"))
        return F.coalesce(
            F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), F.try_to_timestamp(short, F.lit("MMM d yyyy"))
        ).cast("date")

    return F.filter(F.transform(raw, parse), lambda d: d.isNotNull())


def first_json_object(c) -> Column:
    """Strip code fences and take the text from the first `{` to the brace that closes it.

    Braces inside quoted strings don't count; a string that is not closed runs to the end. Without a closing brace:
    empty. One pass: the pattern's runs are possessive, so that neither time nor stack depends on what follows them.
    """
    bare = F.regexp_replace(col(c), r"```(?:json)?\s*+", "")
    rest = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    # runs without a brace outside of strings, and the braces between them
    marks = F.regexp_extract_all(rest, F.lit(r'(?s)[{}]|(?:[^{}"]++|"(?:[^"\\]++|\\.)*+(?:"|\\?\z))++'), F.lit(0))
    end = F.aggregate(
        marks, F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("end")),
        lambda a, m: F.struct(
            (a["at"] + F.length(m)).alias("at"),
            (a["open"] + F.when(m == "{", 1).when(m == "}", -1).otherwise(0)).alias("open"),
            F.when((a["end"] == 0) & (m == "}") & (a["open"] == 1), a["at"] + 1).otherwise(a["end"]).alias("end")))["end"]
    return F.substr(rest, F.lit(1), end)


def canonical_hash(cols: Sequence[str]) -> Column:
    """SHA-256 of a row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


CHUNKS = (64, 4096)


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(xs: Column, zero: Column, step) -> Column:
    """All states of a running step(state, x) over an array, the first one after its first element.

    Arrays can't grow in place, so states are gathered in chunks and chunks of chunks: a state is copied as often as its
    chunk has pieces, not as often as states follow.
    """
    def add(a, x):
        return let(step(a["at"], x), lambda v: F.struct(v.alias("at"), F.concat(a["out"], F.array(v)).alias("out")))

    def run(a, xs, sizes):
        if not sizes:
            return F.aggregate(xs, a, add)

        def part(a, chunk):
            own = run(F.struct(a["at"].alias("at"), F.slice(a["out"], 1, 0).alias("out")), chunk, sizes[:-1])
            return let(own, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["out"]).alias("out")))

        n = F.size(xs)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(sizes[-1]))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(starts, lambda i: F.slice(xs, i, F.lit(sizes[-1]))), a, part)

    begin = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
    return let(xs, lambda xs: run(begin, xs, CHUNKS)["out"])


def match_starts(c, pattern: str) -> Column:
    """0-based start offsets of all matches.

    One pass of the pattern puts each match between control characters (those of the text itself count as another one of
    the same width); the offsets are running sums of the pieces' lengths.
    """
    marked = F.regexp_replace(F.translate(col(c), "\x01", "\x02"), f"({pattern})", "\x01$1\x01")
    ends = scan(F.transform(F.split(marked, "\x01", -1), F.length), F.lit(0), lambda a, n: a + n)
    return let(ends, lambda e: F.filter(e, lambda v, i: (i % 2 == 0) & (i < F.size(e) - 1)))


def first_match(c, pattern: str) -> Column:
    """0-based start offset of the first match; null without one."""
    return let(F.split(col(c), pattern, 2), lambda p: F.when(F.size(p) > 1, F.length(F.get(p, 0))))


def slice_between(c, starts: Sequence[str], ends: Sequence[str], skip: int = 20, cap: int | None = None) -> Column:
    """From the earliest start phrase to the earliest end phrase at least `skip` characters on.

    Without an end phrase the section runs to the end of the text (or is `cap` characters long); without a start
    it is empty.
    """
    c = col(c)
    low = F.lower(c)
    at = F.array_min(F.filter(F.array(*[F.locate(s, low) for s in starts]), lambda p: p > 0))
    # offset of an end phrase inside the rest of the text, made absolute again
    rest = F.substr(low, at + skip)
    end = F.array_min(F.filter(F.array(*[F.locate(e, rest) for e in ends]), lambda p: p > 0))
    size = F.coalesce(end + (skip - 1), F.length(c) if cap is None else F.lit(cap))
    return F.when(at.isNull(), F.lit("")).otherwise(F.trim(F.substr(c, at, size)))


def section_span(
    c, header: str, end: str, loose: str, phrase: str, min_chars: int = 5000
) -> Column:
    """struct(start, stop, path): where a section lies in a text (0-based, stop exclusive).

    A header match counts only before an end marker; of the counting ones the last that is at least
    `min_chars` long wins, else the last. Failing that: first loose match up to the next end marker;
    first phrase to the end; the whole text. Linear in the text and (but for sorting them) in the markers.
    """
    c = col(c)
    s = F.struct(
        F.length(c).alias("n"), match_starts(c, header).alias("h"), match_starts(c, end).alias("e"),
        first_match(c, loose).alias("l"), first_match(c, phrase).alias("p"))
    none = F.lit(None).cast("int")
    state = ("last_end", "ripe", "head", "long", "long_stop", "cand", "cand_stop")

    def step(a, m):
        """Markers in order. A header is ripe min_chars on, unless an end marker lies between; an end marker settles
        the last ripe header and the last one before it."""
        at, kind, x = m["at"], m["kind"], m["x"]
        is_end = kind == 1
        new = {
            "last_end": F.when(is_end, at).otherwise(a["last_end"]),
            "ripe": F.when(is_end, none).when((kind == 0) & (a["last_end"].isNull() | (a["last_end"] <= x)), x).otherwise(a["ripe"]),
            "head": F.when(is_end, none).when(kind == 2, x).otherwise(a["head"]),
        }
        for name, of in (("long", "ripe"), ("cand", "head")):
            settled = is_end & a[of].isNotNull()
            new[name] = F.when(settled, a[of]).otherwise(a[name])
            new[f"{name}_stop"] = F.when(settled, at).otherwise(a[f"{name}_stop"])
        return F.struct(*[new[k].alias(k) for k in state])

    def marks(xs, kind, shift=0):
        return F.transform(xs, lambda x: F.struct((x + shift).alias("at"), F.lit(kind).alias("kind"), x.alias("x")))

    def choose(r):
        order = F.sort_array(F.concat(marks(r["e"], 1), marks(r["h"], 2), marks(r["h"], 0, min_chars)))
        return let(F.aggregate(order, F.struct(*[none.alias(k) for k in state]), step), lambda b: finish(r, b))

    def finish(r, b):
        after = F.array_min(F.filter(r["e"], lambda v: v > r["l"]))
        path = (
            F.when(b["long"].isNotNull(), "long").when(b["cand"].isNotNull(), "short")
            .when(r["l"].isNotNull(), "loose").when(r["p"].isNotNull(), "phrase").otherwise("whole")
        )
        start = F.coalesce(b["long"], b["cand"], r["l"], r["p"], F.lit(0))
        stop = F.coalesce(b["long_stop"], b["cand_stop"], after, r["n"])
        return F.struct(start.alias("start"), stop.alias("stop"), path.alias("path"))

    return F.when(c.isNotNull(), let(s, choose))


ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _entity(e: Column) -> Column:
    """The character of an entity; an unknown one stays as it is."""
    digits = F.when(F.substring(e, 3, 1).isin("x", "X"), F.conv(F.regexp_extract(e, r"[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(
        F.regexp_extract(e, r"#(\d+)", 1)).try_cast("int")
    plain = digits.between(1, 0xD7FF) | digits.between(0xE000, 0x10FFFF)
    number = F.when(plain, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))
    names = F.map_from_arrays(F.split(F.lit(" ".join(sorted(name2codepoint))), " "), F.split(F.lit(
        "\x01".join(chr(code) for _, code in sorted(name2codepoint.items()))), "\x01"))  # two literals, folded once
    name = F.try_element_at(names, F.regexp_extract(e, r"&(\w+);", 1))
    return F.coalesce(F.when(e.startswith("&#"), number).otherwise(name), e)


def decode_entities(c) -> Column:
    """Numeric and named character entities as characters, each once and from left to right."""
    def decode(x):
        gaps, found = F.split(x, ENTITY, -1), F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0))
        parts = F.zip_with(gaps, found, lambda g, e: F.concat(g, F.coalesce(_entity(e), F.lit(""))))
        return F.when(F.contains(x, F.lit("&")), F.array_join(parts, "")).otherwise(x)

    return let(col(c), decode)


_ATTRIBUTES = r"""(?:[^>"']|"[^"]*+"|'[^']*+'|["'])*+"""


def drop_blocks(c, tag: str) -> Column:
    """Drop what lies between each <tag> and the </tag> that closes it, at any depth; a `>` in quotes ends no tag.

    A block that is not closed keeps its text, and so does what stands before a </tag> that closes nothing. Marks stand
    in one pass of a pattern; a running depth over them, and its least value from each on, say which pieces are inside.
    """
    mark = rf"(?i)(<{tag}\b{_ATTRIBUTES}>|</{tag}\s*+>)"

    def cut(parts):
        marks = F.filter(parts, lambda x, i: i % 2 == 1)
        depth = scan(F.transform(marks, lambda m: F.when(m.startswith("</"), -1).otherwise(1)), F.lit(0),
                     lambda a, d: F.greatest(a + d, F.lit(0)))

        def outside(depth):
            later = F.reverse(scan(F.reverse(depth), F.lit(2 ** 31 - 1), lambda a, d: F.least(a, d)))
            return F.zip_with(depth, later, lambda d, low: d <= low)

        # piece 2i + 2 lies behind mark i; marks of blocks go with them
        def keep(ok):
            own = F.filter(parts, lambda x, i: (i % 2 == 0) & ((i == 0) | F.coalesce(F.get(ok, F.floor(i / 2).cast("int") - 1), F.lit(True))))
            return F.array_join(own, " ")

        return let(let(depth, outside), keep)

    def whole(x):
        parts = F.split(F.regexp_replace(F.translate(x, "\x01", " "), mark, "\x01$1\x01"), "\x01", -1)
        return F.when(x.rlike(rf"(?i)</?{tag}\b"), let(parts, cut)).otherwise(x)

    return let(col(c), whole)


def strip_html(c) -> Column:
    """Drop script, style and table blocks and all tags, decode entities, collapse white space.

    A script or style block that is not closed runs to the end. Tables may lie in tables at any depth.
    """
    c = col(c)
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", " ")
    c = drop_blocks(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), "table")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    return collapse_space(decode_entities(c))


def word_fractions(c, lexicons: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Share of words in each lexicon, and the word count. Lexicon words that are not plain letters match
    nothing, as the text is reduced to letters first."""
    flat = F.concat(F.lit(" "), F.lower(letters_only(c, keep_space=True)), F.lit(" "))

    def hits(words: Sequence[str]) -> Column:
        plain = [w for w in dict.fromkeys(words) if w.isascii() and w.isalpha()]
        return F.regexp_count(flat, F.lit(f" (?:{'|'.join(plain)})(?= )")) if plain else F.lit(0)

    n = F.regexp_count(flat, F.lit("[a-z]+"))
    return {**{k: hits(ws) / F.greatest(n, F.lit(1)) for k, ws in lexicons.items()}, "n_words": n}
