"""The query language: words, "phrases", prefix*, fuzzy~2, field:word, NEAR(a b, 5), AND, OR, NOT and parentheses.

A query string is read on the driver into a small tree. What does not parse (bare words side by side, stray signs) is asked
for as it stands: all its words, unstemmed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from siftlake.functions.analysis import analyzed_words, index_words, is_stop_word, query_words, stem

FIELDS = ("title", "content")
NEAR_DEFAULT, FUZZY_DEFAULT = 5, 2


class QueryError(ValueError):
    """A query string that does not follow the grammar."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Prefix:
    word: str


@dataclass(frozen=True)
class Fuzzy:
    word: str
    distance: int = FUZZY_DEFAULT


@dataclass(frozen=True)
class Field:
    name: str
    query: Query


@dataclass(frozen=True)
class Near:
    words: tuple[str, ...]
    distance: int = NEAR_DEFAULT


@dataclass(frozen=True)
class And:
    left: Query
    right: Query


@dataclass(frozen=True)
class Or:
    left: Query
    right: Query


@dataclass(frozen=True)
class Not:
    query: Query


Query = Term | Phrase | Prefix | Fuzzy | Field | Near | And | Or | Not

_LEXEME = re.compile(r"""\s*(?:"([^"]*)"?|'([^']*)'?|(\d+)(?![\w-])|([^\W\d][\w-]*\*?)|(.))""", re.S)


def _lexemes(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, end): 'string', 'number', 'word' or the sign itself."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEXEME.match(text, at)
        at = m.end()
        kind = ("string", "string", "number", "word", None)[m.lastindex - 1] or m[5]
        out.append((kind, m[m.lastindex], at))
    return out


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _lexemes(text), 0

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", len(self.text))

    def take(self) -> tuple[str, str, int]:
        self.at += 1
        return self.tokens[self.at - 1]

    def keyword(self, name: str) -> bool:
        kind, word, _ = self.peek()
        if kind == "word" and word.upper() == name:
            self.at += 1
            return True
        return False

    def either(self) -> Query:
        left = self.both()
        while self.keyword("OR"):
            left = Or(left, self.both())
        return left

    def both(self) -> Query:
        left = self.one()
        while self.keyword("AND"):
            left = And(left, self.one())
        return left

    def one(self) -> Query:
        if self.keyword("NOT"):
            return Not(self.one())
        kind, word, end = self.peek()
        if kind == "end":
            raise QueryError("the query ends where a word is expected")
        self.at += 1
        if kind == "(":
            inner = self.either()
            if self.peek()[0] != ")":
                raise QueryError("a parenthesis is not closed")
            self.at += 1
            return inner
        if kind == "string":
            return Phrase(tuple(query_words(word)))
        if kind == "number":
            return Term(word)
        if kind != "word":
            raise QueryError(f"{word!r} has no meaning here")
        after = self.peek()
        if word.upper() == "NEAR" and after[0] == "(":
            return self.near()
        if word.upper() in ("AND", "OR"):
            raise QueryError(f"{word} stands where a word is expected")
        if after[0] == ":" and after[2] == end + 1:
            self.at += 1
            if word.lower() not in FIELDS:
                raise QueryError(f"there is no field {word}")
            return Field(word.lower(), self.one())
        if word.endswith("*"):
            return Prefix(word[:-1])
        if after[0] == "~":
            self.at += 1
            return Fuzzy(word, int(self.take()[1]) if self.peek()[0] == "number" else FUZZY_DEFAULT)
        return Phrase(tuple(word.split("-"))) if "-" in word.strip("-") else Term(word.strip("-"))

    def near(self) -> Query:
        self.at += 1
        words: list[str] = []
        while self.peek()[0] not in (")", "end"):
            kind, word, _ = self.take()
            if kind in ("word", "number"):
                words.append(word)
            elif kind == "string":
                words.extend(query_words(word))
            elif kind != ",":
                raise QueryError(f"{word!r} has no meaning in NEAR")
        if self.peek()[0] == ")":
            self.at += 1
        distance = int(words.pop()) if len(words) > 2 and words[-1].isdigit() else NEAR_DEFAULT
        if len(words) < 2:
            raise QueryError("NEAR takes two words or more")
        return Near(tuple(w.rstrip("*") for w in words), distance)


def parse(text: str) -> Query | None:
    """The tree of a query; None if it is empty. Raises QueryError where it breaks the grammar."""
    if not text or not text.strip():
        return None
    reader = _Reader(text)
    tree = reader.either()
    if reader.peek()[0] != "end":
        raise QueryError(f"{reader.peek()[1]!r} follows without AND or OR")
    return tree


def raw(text: str) -> Query | None:
    """All words of a text, as the index spells them."""
    words = index_words(text or "")
    tree: Query | None = None
    for w in words:
        tree = Term(w) if tree is None else And(tree, Term(w))
    return tree


def read(text: str, mode: str = "structured", language: str = "en", stemming: bool = True) -> Query | None:
    """The tree to evaluate: parsed and lowered to index words, or all words as they stand where parsing fails or mode is 'raw'."""
    if mode == "raw":
        return raw(text)
    try:
        tree = parse(text)
    except QueryError:
        return raw(text)
    return None if tree is None else lowered(tree, language, stemming)


def lowered(q: Query, language: str = "en", stemming: bool = True) -> Query:
    """The same tree over index words: a word that its stem changes becomes the stem as a prefix; a stop word stays as it is.

    Phrases keep their words as written: they are looked for in that form.
    """
    down = lambda x: lowered(x, language, stemming)
    match q:
        case Term(word):
            words = index_words(word)
            if len(words) != 1:
                return Phrase(tuple(words)) if words else Term("")
            base = word.lower()
            if stemming and not is_stop_word(base, language) and (s := stem(base, language)) != base:
                return Prefix(index_words(s)[0])
            return Term(words[0])
        case Phrase(words):
            flat = tuple(w for x in words for w in index_words(x))
            return Term(flat[0]) if len(flat) == 1 else Phrase(flat)
        case Prefix(word) | Fuzzy(word, _):
            base = word.lower()
            s = stem(base, language) if stemming and not is_stop_word(base, language) else base
            return Prefix((index_words(s) or [""])[0])
        case Near(words, distance):
            return Near(tuple(w for x in words for w in index_words(x)), distance)
        case Field(name, inner):
            return Field(name, down(inner))
        case And(left, right):
            return And(down(left), down(right))
        case Or(left, right):
            return Or(down(left), down(right))
        case Not(inner):
            return Not(down(inner))
    raise TypeError(q)


def text_of(q: Query | None, language: str | None = None) -> str:
    """A tree as text; with a language, words are shown as they are asked for (stems with a star)."""

    def word(w: str) -> str:
        if language is None or is_stop_word(w.lower(), language):
            return w
        s = (analyzed_words(w, language, stop=False) or [w])[0]
        return s + "*" if s != w.lower() else w

    match q:
        case None:
            return ""
        case Term(w):
            return word(w)
        case Phrase(words):
            return '"' + " ".join(map(word, words)) + '"'
        case Prefix(w) | Fuzzy(w, _):
            return word(w).rstrip("*") + "*"
        case Field(name, inner):
            return f"{name}:{text_of(inner, language)}"
        case Near(words, n):
            return f"NEAR({' '.join(map(word, words))}, {n})"
        case And(a, Not(b)):
            return f"({text_of(a, language)} NOT {text_of(b, language)})"
        case And(a, b):
            return f"({text_of(a, language)} AND {text_of(b, language)})"
        case Or(a, b):
            return f"({text_of(a, language)} OR {text_of(b, language)})"
        case Not(a):
            return f"(* NOT {text_of(a, language)})"
    raise TypeError(q)
