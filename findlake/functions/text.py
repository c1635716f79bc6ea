"""Column functions on text, paths and patterns, all in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "␟"
# fixed values: words that carry no meaning in a title
STOP_WORDS = ("the", "a", "an", "is", "are", "not", "no", "in", "on", "for", "of", "to", "with", "and", "or", "be", "this", "that", "it", "has", "have", "should")


def snippet(text: Column) -> Column:
    """White space as one space, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def short_hash(prefix: str, *parts: Column) -> Column:
    """Prefix and the first twelve hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 12))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def words(text: Column) -> Column:
    """Distinct words of a title over two letters, without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of words; 0 when either is empty."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / total)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.split(text, "")
    chars = F.filter(chars, lambda c: c != "")
    n = F.size(chars).cast("double")
    terms = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))


def masked(value: Column) -> Column:
    """The first and last four characters, stars between; all stars for a short value."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4))))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def route(path: Column) -> Column:
    """A route for comparison: parameters as {}, no trailing slash, lower case."""
    out = F.regexp_replace(path, r"\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*|\$\{[^}]*\}", "{}")
    out = F.regexp_replace(F.lower(out), "/+$", "")
    return F.when(out == "", "/").otherwise(out)


def ancestors(path: Column) -> Column:
    """Every folder above a path, nearest first, "" last."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    n = F.size(parts)
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


#: A set of characters in a path pattern; an opening bracket that none closes stands for itself.
BRACKET = re.compile(r"\[(?P<other>!?)(?P<some>[^\]]+)\]")


def glob(pattern: str, across: bool = False) -> str:
    """A regular expression for a path pattern.

    `*` stays inside a segment and `**` spans segments, zero or more; with `across`, `*` crosses slashes too and `**` is
    nothing special, the way shell-style name patterns match.
    """
    pattern = pattern.replace("\\", "/")
    while not across and pattern.startswith("./"):
        pattern = pattern[2:]
    out, i = [], 0
    while i < len(pattern):
        rest = pattern[i:]
        if not across and (i == 0 or pattern[i - 1] == "/") and re.match(r"\*\*(/|$)", rest):
            out.append("(?:.*/)?" if len(rest) > 2 else ".*")
            i += 3
            continue
        c = pattern[i]
        if c == "*":
            out.append(".*" if across else "[^/]*")
        elif c == "?":
            out.append("." if across else "[^/]")
        elif found := BRACKET.match(pattern, i):
            some = found["some"].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if found['other'] else ''}{some}]")
            i = found.end() - 1
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches(path: Column, pattern: str, across: bool = False) -> Column:
    return path.rlike(glob(pattern, across))


def glob_column(pattern: Column) -> Column:
    """The same for patterns in a column (names, `*` crosses slashes)."""
    out = F.regexp_replace(pattern, r"([.^$+(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(out, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
