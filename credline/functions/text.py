"""Text functions: cleaning, tokenising, de-duplication keys and tag removal.

Everything is a JVM-side expression (higher-order array functions and Java
regexes), so it runs inside whole-stage code generation and needs no Python
worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credline.schemas import ALLOWED_SHORT_TOKENS, LETTER, NA_LITERALS, NON_WORD, WS_CLASS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Whitespace tokens of ``text`` the way Python's ``str.split()`` cuts them."""
    return F.filter(F.split(_c(text), WS_CLASS + "+"), lambda t: t != F.lit(""))


def strip_ws(text) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_c(text), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def clean_ocr(text) -> Column:
    """Drop lines without a letter; keep tokens longer than one character that hold a
    letter, or an allowed one-character token; join what is left by single spaces."""
    lines = F.filter(F.split(_c(text), "\n"), lambda ln: ln.rlike(LETTER))
    words = F.flatten(F.transform(lines, lambda ln: tokens(ln)))
    keep = F.filter(
        words,
        lambda w: ((F.length(w) > 1) & w.rlike(LETTER)) | w.isin(*ALLOWED_SHORT_TOKENS),
    )
    return F.array_join(keep, " ")


def dedupe_key(text) -> Column:
    """Normalised text for near-duplicate detection: lower case, word characters only."""
    return F.regexp_replace(F.lower(strip_ws(text)), NON_WORD, "")


def tag_all_o(text) -> Column:
    """Tag every token of a rejected text as outside any role or filler."""
    return F.array_join(F.transform(tokens(text), lambda t: F.concat(t, F.lit("@O"))), " ")


def untag(tagged) -> Column:
    """Remove each ``@tag`` (up to the next space or the end) and tokenise the rest."""
    return tokens(F.regexp_replace(_c(tagged), "(?d)@.*? |@.*$", " "))


def verbatim_ok(tagged, text) -> Column:
    """True when the tagged text carries exactly the tokens of the source text."""
    return untag(tagged) == tokens(text)


def split_lines_stripped(value) -> Column:
    """Split a multi-line field on newlines and strip every piece (empty pieces stay)."""
    return F.transform(F.split(_c(value), "\n"), lambda p: strip_ws(p))


def na_to_null(c) -> Column:
    """Turn the string literals the pandas CSV reader treats as missing into NULL."""
    col = _c(c)
    return F.when(col.isin(*NA_LITERALS), F.lit(None).cast("string")).otherwise(col)


def append_joined(pieces) -> Column:
    """Fold of ``s = r if not s else s + ' ' + r`` over an ordered array of strings:
    leading empty pieces vanish, everything after the first non-empty piece is joined
    with single spaces."""
    arr = _c(pieces)
    first = F.array_position(F.transform(arr, lambda x: x != F.lit("")), F.lit(True))
    return F.when(first == 0, F.lit("")).otherwise(
        F.array_join(F.slice(arr, F.greatest(first, F.lit(1)), F.size(arr)), " "))
