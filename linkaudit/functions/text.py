"""Text expressions with Python string semantics, all evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: Every character Python's ``str.strip()`` and ``str.split()`` treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
def text(col: Column) -> Column:
    """Missing cells read as empty text."""
    return F.coalesce(col, F.lit(""))


def py_strip(col: Column) -> Column:
    """``str.strip()``: also no-break and other Unicode blanks, unlike ``trim``."""
    return F.btrim(col, F.lit(BLANKS))


def py_lower(col: Column) -> Column:
    return F.lower(col)


def py_words(col: Column) -> Column:
    """``str.split()``: no empty words, an empty array for blank text.

    Splitting at a single character needs no regular expression, which would be compiled per row.
    """
    spaced = F.translate(col, BLANKS, " " * len(BLANKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def contains_any(col: Column, fragments: Iterable[str]) -> Column:
    """Substring test against a list of literals.

    A chain of plain searches, which is several times faster than one alternation.
    """
    return reduce(or_, (col.contains(f) for f in fragments), F.lit(False))


def starts_with_any(col: Column, prefixes: Iterable[str]) -> Column:
    return reduce(or_, (col.startswith(p) for p in prefixes), F.lit(False))


def _whole_alternation(pattern: str) -> bool:
    """Whether a ``|`` stands outside of all groups and classes."""
    depth, in_class, escaped = 0, False, False
    for c in pattern:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return True
    return False


#: A back-reference, a named group or inline flags.
_OF_ITS_OWN = re.compile(r"\\[1-9]|\\k<|\(\?P?<[A-Za-z]|\(\?[a-zA-Z]*-?[a-zA-Z]+[:)]|\(\?P=")


def matches_any(col: Column, patterns: Sequence[str]) -> Column:
    """Unicode, case-insensitive search for any of the patterns.

    Patterns that begin with ``^`` share one anchor, so that they are tried at the start of the
    text only; the others form a second alternation. Patterns that refer to their groups or set
    flags are searched one by one, as joining them would renumber groups and spread flags.
    """
    own = [p for p in patterns if _OF_ITS_OWN.search(p)]
    rooted = [p for p in patterns if p not in own and p.startswith("^") and not _whole_alternation(p)]
    free = [p for p in patterns if p not in own and p not in rooted]
    tests = [col.rlike(f"(?iU){p}") for p in own]
    if rooted:
        tests.append(col.rlike("(?iU)^(?:" + "|".join(p[1:] for p in rooted) + ")"))
    if free:
        tests.append(col.rlike("(?iU)" + "|".join(f"(?:{p})" for p in free)))
    return reduce(or_, tests, F.lit(False))


def truncate(col: Column, n: int) -> Column:
    """The first ``n`` characters followed by ``...`` where the text is longer."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def jaccard_words(a: Column, b: Column) -> Column:
    """Jaccard similarity of the lower-cased word sets; 0 where either text is blank."""
    wa, wb = py_words(F.lower(a)), py_words(F.lower(b))
    both = F.size(F.array_union(wa, wb))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wa, wb)) / both
    )


def ngrams(words: Column, n: int) -> Column:
    """Adjacent ``n``-word phrases of a word array; empty for shorter arrays."""
    grams = F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "),
    )
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def text_md5(col: Column) -> Column:
    """Cache key of a text."""
    return F.md5(col)
