"""SQL text for the DuckDB oracles, built from the same lexicons.

The oracles are independent re-statements of each query in plain SQL; these
helpers only keep the shared constants (word lists, whitespace class) in one
place so the SQL and the DataFrame code cannot drift apart silently.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.text import WS_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_CLASS + '+|' + WS_CLASS + '+' + chr(92) + 'z')}, '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, {q(WS_CLASS + '+')}, ' ', 'g')"


def normalise(x: str) -> str:
    return collapse(strip(x))


def any_contains(x: str, words, lower=True) -> str:
    t = f"lower({x})" if lower else x
    return "(" + " OR ".join(f"contains({t}, {q(w.lower() if lower else w)})" for w in words) + ")"


def first_contained(x: str, words) -> str:
    t = f"lower({x})"
    return "CASE " + " ".join(f"WHEN contains({t}, {q(w.lower())}) THEN {q(w)}" for w in words) + " END"


def count_contained(x: str, words) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, {q(w.lower())}) THEN 1 ELSE 0 END)"
                            for w in words) + ")"


def pct2(a: str, b: str) -> str:
    """Percentage a/b with two decimals, half-up, 0 when b is 0 (integer exact)."""
    return (f"(CASE WHEN ({b}) > 0 THEN floor((20000 * ({a}) + ({b})) / (2.0 * ({b}))) / 100.0 "
            f"ELSE 0.0 END)")


def sqdist(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))")


def rule_intent(t: str) -> str:
    parts = []
    for intent, pats in L.INTENT_RULES.items():
        for p in pats:
            parts.append(f"WHEN regexp_matches({t}, {q('(?i)' + p)}) THEN {q(intent)}")
    return "CASE " + " ".join(parts) + " END"


def keyword_score(t: str, kws) -> str:
    return "(" + " + ".join(
        f"(CASE WHEN {t} = {q(k.lower())} THEN 10 WHEN contains({t}, {q(k.lower())}) THEN 1 ELSE 0 END)"
        for k in kws) + ")"


def keyword_intent(t: str) -> str:
    names = list(L.INTENT_KEYWORDS)
    scores = {i: keyword_score(t, L.INTENT_KEYWORDS[i]) for i in names}
    best = "greatest(" + ", ".join(scores[i] for i in names) + ")"
    return ("CASE " + " ".join(f"WHEN {scores[i]} = {best} AND {best} > 0 THEN {q(i)}" for i in names)
            + " END")
