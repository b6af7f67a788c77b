"""The query language: classes of queries, their words, and the tree of a boolean query.

query := or; or := and (OR and)*; and := atom (AND atom)*; atom := '(' or ')' | word | nothing (a dropped stopword).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from textloom.functions.text import porter_stem

ONE_WORD, BOOLEAN, PHRASE, FREE, WILDCARD, WILDCARD_PHRASE = "one_word", "boolean", "phrase", "free_text", "wildcard", "wildcard_phrase"


@dataclass
class Query:
    text: str
    kind: str
    words: list[str]
    tree: tuple | None = None
    weights: dict[str, float] = field(default_factory=dict)


def classify(query: str) -> str:
    body = query.strip()
    quoted = len(body) > 1 and body[0] == body[-1] == '"'
    inner = body[1:-1].strip() if quoted else body
    if "*" in inner:
        return WILDCARD_PHRASE if " " in inner else WILDCARD
    if quoted:
        return PHRASE
    if any(w in ("AND", "OR") for w in re.sub(r"[()]", " ", inner).split()):
        return BOOLEAN
    return FREE if " " in inner else ONE_WORD


def clean_word(word: str, stopwords: frozenset[str], stem: bool) -> str | None:
    """None for stopwords (before or after stemming) and for words without letters and digits. Patterns keep their stars."""
    w = re.sub(r"[^a-z0-9*]", "", word.lower())
    if "*" in w:
        return w
    if not w or w in stopwords:
        return None
    if stem:
        w = porter_stem(w)
    return None if w in stopwords else w


def parse(query: str, stopwords=(), stem: bool = False) -> Query:
    stop, kind = frozenset(stopwords), classify(query)
    lexed = re.findall(r"[()]|[^\s()\"]+", query)
    if kind != BOOLEAN:
        words = [c for w in lexed if w not in "()" and (c := clean_word(w, stop, stem))]
        out = Query(query, kind, words)
    else:
        items = [w if w in ("(", ")", "AND", "OR") else ("w", clean_word(w, stop, stem)) for w in lexed]
        tree, rest = _or(items, 0)
        while rest < len(items):  # an unmatched ) ends nothing
            more, rest = _or(items, rest + 1)
            tree = ("or", tree, more)
        out = Query(query, kind, [x[1] for x in items if isinstance(x, tuple) and x[1]], tree)
    total = len(out.words)
    out.weights = {w: n / total for w, n in Counter(out.words).items()} if total else {}
    return out


def _or(items, i):
    tree, i = _and(items, i)
    while i < len(items) and items[i] == "OR":
        right, i = _and(items, i + 1)
        tree = ("or", tree, right)
    return tree, i


def _and(items, i):
    tree, i = _atom(items, i)
    while i < len(items) and items[i] not in ("OR", ")"):
        if items[i] == "AND":
            right, i = _atom(items, i + 1)
            tree = ("and", tree, right)
        else:  # two atoms side by side: either
            right, i = _atom(items, i)
            tree = ("or", tree, right)
    return tree, i


def _atom(items, i):
    if i >= len(items) or items[i] in ("AND", "OR", ")"):
        return ("w", None), i
    if items[i] == "(":
        tree, i = _or(items, i + 1)
        return tree, i + 1 if i < len(items) else i
    return items[i], i + 1


def as_sql(tree: tuple, flag) -> str:
    """The tree over flag(word), an SQL condition; a dropped word is false."""
    if tree[0] == "w":
        return flag(tree[1]) if tree[1] else "false"
    return f"({as_sql(tree[1], flag)} {tree[0]} {as_sql(tree[2], flag)})"


def products(tree: tuple, most: int = 64) -> list[frozenset] | None:
    """The tree as sets of words, of which one must be there in full; none of them contains another. None if there are more than `most` or too many words for a bit each."""
    if tree[0] == "w":
        return [frozenset([tree[1]])] if tree[1] else []
    left, right = products(tree[1], most), products(tree[2], most)
    if left is None or right is None:
        return None
    both = left + right if tree[0] == "or" else [a | b for a in left for b in right]
    least = [p for p in dict.fromkeys(both) if not any(q < p for q in both)]
    return least if len(least) <= most and len(set().union(*least)) <= 62 else None
