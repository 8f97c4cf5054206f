"""Text functions as Spark columns: tokens, queries, scores.  All of them run inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that a task description holds but a search should not weigh, unless they stand alone
STOP_WORDS = frozenset("a add an and build change create feature fix for implement in make new of on or please support the to update with".split())
# fixed values: ranking constants
K1, B, PHRASE_WEIGHT, COVERAGE_BASE, COVERAGE_WEIGHT = 1.2, 0.75, 0.75, 0.35, 0.65


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens; a capital after a small letter or digit begins a new one."""
    spaced = F.regexp_replace(text, r"([\p{Ll}0-9])(?=\p{Lu})", "$1 ")
    plain = F.btrim(F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(plain, " "), "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """Lines of a text, without a trailing empty one."""
    all_ = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    return let(all_, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def py_tokens(text: str) -> list[str]:
    """The same tokens for the few words of a query."""
    out, before = [], False
    for c in text:
        if c.isupper() and before:
            out.append(" ")
        out.append(c.lower() if c.isalnum() else " ")
        before = c.islower() or c in "0123456789"
    return "".join(out).split()


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()


def _words(text: str) -> list[tuple[str, bool]]:
    """White-space words with quotes and backslash escapes, and whether each was quoted."""
    words, word, quote, quoted, open_ = [], [], "", False, False
    escaped = False
    for c in text:
        if escaped:
            word.append(c)
            escaped, open_ = False, True
        elif c == "\\":
            escaped = True
        elif quote:
            if c == quote:
                quote = ""
            else:
                word.append(c)
        elif c in "\"'" and not open_ or c in "\"'" and word == ["-"]:
            quote, quoted, open_ = c, True, True
        elif c.isspace():
            if open_:
                words.append(("".join(word), quoted))
            word, quoted, open_ = [], False, False
        else:
            word.append(c)
            open_ = True
    if quote:
        raise ValueError("the query has an unterminated quote")
    if open_:
        words.append(("".join(word), quoted))
    return words


def parse_query(text: str) -> Query:
    """Terms, -excluded words and "phrases"; raises ValueError for a query without terms."""
    terms, excluded, phrases = [], [], []
    for word, quoted in _words(text):
        minus = word.startswith("-") and len(word) > 1
        own = py_tokens(word[1:] if minus else word)
        if minus:
            excluded += own
        else:
            terms += own
            if quoted and len(own) > 1:
                phrases.append(tuple(own))
    kept = sorted(set(terms))
    if len(kept) > 1:
        kept = [t for t in kept if t not in STOP_WORDS] or kept
    if not kept:
        raise ValueError("the query has no terms")
    return Query(tuple(kept), tuple(sorted(set(excluded))), tuple(phrases))


def path_allowed(path: Column, prefixes: list[str]) -> Column:
    """A path is one of the prefixes or below one; no prefix allows all."""
    found = F.lit(not prefixes)
    for p in prefixes:
        found = found | (path == p) | path.startswith(p.rstrip("/") + "/")
    return found


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(average, F.lit(1.0))))


def milli(score: Column) -> Column:
    """A score in thousandths as an integer; 0 for what isn't a positive number."""
    return F.when(F.isnan(score) | (score <= 0) | score.isNull(), F.lit(0)).otherwise(F.least(F.round(score * 1000), F.lit(4294967295.0))).cast("long")


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= d) & (c <= b)


def substantially_overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Half of the shorter range at least is shared."""
    shared = F.least(b, d) - F.greatest(a, c) + 1
    return (shared > 0) & (2 * shared >= F.least(b - a + 1, d - c + 1))


def estimated_tokens(text: Column) -> Column:
    """Budget units of an excerpt: a quarter of its bytes and of a header of 64."""
    return F.ceil((F.octet_length(text) + 64) / 4).cast("long")
