"""Text column functions (JVM-side expressions only).

Python and the JVM disagree on several text rules; these helpers pin the
Python behaviour we reproduce:

* whitespace is the set accepted by ``str.isspace`` (``WS_CLASS``), written
  with ``\\x{..}`` escapes that Java regex and RE2 read alike;
* ``.`` must not cross ``\\n`` only, hence the ``(?d)`` (UNIX_LINES) flag;
* lengths and substrings count code points (Spark ``length``/``substr`` do).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

WS_CLASS = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_(c), rf"^{WS_CLASS}+|{WS_CLASS}+\z", "")


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', s)`` with Python's Unicode ``\\s``."""
    return F.regexp_replace(col_(c), rf"{WS_CLASS}+", " ")


def normalise_line(c) -> Column:
    """Strip, then every whitespace run becomes one space."""
    return collapse_ws(py_strip(c))


def any_contains(c, words, lower: bool = True) -> Column:
    """True when the (lower-cased) text contains any of ``words``."""
    t = F.lower(col_(c)) if lower else col_(c)
    return reduce(lambda a, b: a | b,
                  [t.contains(w.lower() if lower else w) for w in words])


def first_contained(c, words, lower: bool = True) -> Column:
    """The first word of ``words`` (list order) contained in the text, else null."""
    t = F.lower(col_(c)) if lower else col_(c)
    return F.coalesce(*[F.when(t.contains(w.lower() if lower else w), F.lit(w))
                        for w in words])


def first_spam_keyword(c, keywords=None) -> Column:
    return first_contained(c, keywords or L.SPAM_KEYWORDS)


def count_contained(c, words, lower: bool = True) -> Column:
    """Number of entries of ``words`` contained (duplicates count twice)."""
    t = F.lower(col_(c)) if lower else col_(c)
    return reduce(lambda a, b: a + b,
                  [F.when(t.contains(w.lower() if lower else w), 1).otherwise(0)
                   for w in words])


def split_sentences(c, terminators: str = L.SENTENCE_TERMINATORS_CJK,
                    min_length: int = L.MIN_SENTENCE_LENGTH) -> Column:
    """Split on terminator runs, strip, keep pieces of ``min_length``+ chars."""
    parts = F.transform(F.split(col_(c), terminators, -1), py_strip)
    return F.filter(parts, lambda s: F.length(s) >= min_length)


def clean_query(c, max_length: int = L.QUERY_MAX_LENGTH) -> Column:
    """Clean a generated retrieval query."""
    x = py_strip(c)
    x = F.regexp_replace(x, rf"(?md)^\p{{Nd}}+[.)]{WS_CLASS}*", "")
    x = F.regexp_replace(x, r"\n+", " ")
    x = collapse_ws(x)
    x = py_strip(x)
    return F.substring(x, 1, max_length)


def keyword_hits(text, keywords) -> Column:
    """Keywords (array column) contained in text, case-sensitive, keyword order."""
    return F.filter(col_(keywords), lambda k: col_(text).contains(k))


def keyword_score(text, keywords) -> Column:
    """Number of keywords contained in the text."""
    return F.size(keyword_hits(text, keywords))


def compression_ratio(before, after) -> Column:
    """``(1 - after/before) * 100``; 0 when ``before`` is 0."""
    b, a = col_(before), col_(after)
    return F.when(b > 0, (F.lit(1.0) - a / b) * 100.0).otherwise(F.lit(0.0))


def preview(c, n: int) -> Column:
    """First ``n`` characters, newlines turned into spaces."""
    return F.replace(F.substring(col_(c), 1, n), F.lit("\n"), F.lit(" "))


def words(c) -> Column:
    """Lower-cased letter runs (the tokenizer of the keyword extractors); a run of
    Chinese characters, which has no spaces to cut at, becomes its bigrams."""
    t = F.lower(col_(c))
    runs = F.regexp_extract_all(t, F.lit(r"(\p{IsHan}+|[\p{L}&&[^\p{IsHan}]]+)"), 1)
    pairs = F.transform(runs, lambda r: F.when(
        r.rlike(r"^\p{IsHan}{2,}"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
        .otherwise(F.array(r)))
    return F.when(t.rlike(r"\p{IsHan}"), F.flatten(pairs)).otherwise(
        F.regexp_extract_all(t, F.lit(r"(\p{L}+)"), 1))


def char_ngrams(c, n: int) -> Column:
    """All character n-grams of a string, in position order."""
    s = col_(c)
    return F.when(F.length(s) >= n,
                  F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)),
                              lambda i: F.substring(s, i, n))
                  ).otherwise(F.array().cast("array<string>"))


def real_client_ip(xff, x_real_ip, remote_addr, trust_proxy: bool = True) -> Column:
    """First X-Forwarded-For entry, else X-Real-IP, else the peer address.

    As in the reference, a present but blank first entry is returned as is
    (stripped) rather than falling through.
    """
    if not trust_proxy:
        return col_(remote_addr)
    first = py_strip(F.split(col_(xff), ",", -1).getItem(0))
    has_xff = col_(xff).isNotNull() & (col_(xff) != "")
    has_real = col_(x_real_ip).isNotNull() & (col_(x_real_ip) != "")
    return (F.when(has_xff, first)
            .when(has_real, col_(x_real_ip))
            .otherwise(col_(remote_addr)))
