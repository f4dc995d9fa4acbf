"""What a query string asks for: full-text phrases, terms, intent. Plain Python on the driver, microseconds a query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import regex

# Fixed values that results depend on.
STOP_WORDS = frozenset(
    "the a an is are was were what how where when why which who that this to for of in on at by with from "
    "implements conforms types type class struct actor enum protocol extension".split()
)
STANDARD_PROTOCOLS = (
    "Comparable", "Equatable", "Hashable", "Codable", "Sendable", "CustomStringConvertible",
    "CustomDebugStringConvertible", "Encodable", "Decodable", "Identifiable", "CaseIterable",
)
QUESTION_WORDS = ("how ", "what ", "where ", "why ", "which ")
VECTOR_PHRASES = ("nearest neighbor", "vector search", "similarity search", "semantic search", "k-nearest", "knn", "embedding search")
IMPLEMENTATION_PHRASES = ("implement", "implements", "implementing", "conforms to", "conforming to", "inherits", "inheriting", "extends", "subclass of", "child of")
TYPE_PHRASES = ("what implements", "which implements", "find implementations of", "classes that implement", "structs that implement", "types that implement", "conforms to", "inherits from")
CONFORMANCE_PATTERNS = (
    r"implements\s+(\w+)",
    r"conforms\s+to\s+(\w+)",
    r"what\s+implements\s+(\w+)",
    r"types?\s+implementing\s+(\w+)",
    r"classes?\s+implementing\s+(\w+)",
    r"structs?\s+implementing\s+(\w+)",
    r"actors?\s+implementing\s+(\w+)",
)
KIND_WORDS = ("protocol", "class", "struct", "actor")
DELETED = re.compile(r"[?*+^(){}\[\]|\\:~]")
RAW_BREAKS = re.compile(r'["*():\-^\s]+')

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")


def tokenize(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _TOKEN.findall(text.lower())


def is_camel_case(word: str) -> bool:
    """Three characters or more, a letter first, and both an upper and a lower case letter: `Find` counts."""
    return len(word) >= 3 and word[0].isalpha() and any(c.isupper() for c in word) and any(c.islower() for c in word)


@dataclass(frozen=True)
class Phrase:
    """Tokens that must stand next to each other in one field; the last may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool


@dataclass(frozen=True)
class Match:
    phrases: tuple[Phrase, ...]
    every: bool  # all phrases, else any


def _phrase(word: str, prefix: bool) -> Phrase | None:
    tokens = tuple(tokenize(word))
    return Phrase(tokens, prefix) if tokens else None


def prepared_match(query: str, strict_reference: bool = True) -> Match:
    """The chunk search's grammar: words are all required, camel-case ones exactly, others of three characters or more as prefixes.

    A word with a character that is neither letter nor digit makes the whole query an OR of prefixes (strict_reference);
    otherwise its parts are a phrase and all words stay required. Nothing raises."""
    words = [w for w in (DELETED.sub("", w) for w in query.split()) if w]
    if strict_reference and any(regex.search(r"[^\p{L}\p{N}]", w) for w in words):
        return raw_match(" ".join(words))
    found = [_phrase(w, len(w) >= 3 and not is_camel_case(w)) for w in words]
    return Match(tuple(p for p in found if p), True)


def raw_match(query: str) -> Match:
    """The snippet search's grammar: an OR of prefixes; the words OR, AND and NOT are left out."""
    words = [w for w in RAW_BREAKS.split(query) if w and w.upper() not in ("OR", "AND", "NOT")]
    return Match(tuple(p for p in (_phrase(w, True) for w in words) if p), False)


def snippet_match(query: str) -> Match:
    """A query that is already all quoted words keeps its form (and AND); any other is raw."""
    if regex.fullmatch(r'("[\p{L}\p{N}]+"\*?(\s+|$))+', query):
        return Match(tuple(Phrase(tuple(tokenize(w)), bool(star)) for w, star in regex.findall(r'"([\p{L}\p{N}]+)"(\*?)', query)), True)
    return raw_match(query)


def query_terms(query: str) -> list[str]:
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", query) if len(w) >= 2 and w.lower() not in STOP_WORDS]


def camel_terms(query: str) -> list[str]:
    return [w for w in query_terms(query) if is_camel_case(w)]


def is_conceptual(query: str) -> bool:
    low = query.lower()
    return any(w in low for w in (*QUESTION_WORDS, *VECTOR_PHRASES))


def conformance_target(query: str, strict_reference: bool = False) -> str | None:
    """The protocol asked for. As written, or with only its first letter upper case (strict_reference)."""
    low = query.lower()
    for pattern in CONFORMANCE_PATTERNS:
        if m := re.search(pattern, low):
            name = m[1] if strict_reference else query[m.start(1) : m.end(1)] if len(low) == len(query) else m[1]
            return name[:1].upper() + name[1:]
    return None


@dataclass
class Intent:
    implementation: bool = False
    protocol: bool = False
    types: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)

    @property
    def reranks(self) -> bool:
        return self.implementation or bool(self.kinds)


def intent(query: str) -> Intent:
    low = query.lower()
    found = Intent(any(p in low for p in IMPLEMENTATION_PHRASES), "protocol" in low)
    for phrase in TYPE_PHRASES:
        at = low.find(phrase)
        if at >= 0 and (rest := query[at + len(phrase) :].split()):
            found.types.append(rest[0][:1].upper() + rest[0][1:])
    for name in re.findall(r"\b[A-Z][a-zA-Z0-9]+\b", query):
        if name not in found.types:
            found.types.append(name)
    found.kinds = [k for k in KIND_WORDS if k in low]
    return found


@dataclass(frozen=True)
class SearchOptions:
    """limit, share of the semantic list, rank constant, over-fetch factors and filters."""

    limit: int = 20
    semantic_weight: float = 0.7
    rrf_k: int = 60
    alpha: float = 0.7
    fetch_factor: int = 5
    result_factor: int = 2
    path_filter: str | None = None
    extensions: tuple[str, ...] = ()
    multi_hop: int = 0
    conformance_weight: float = 3.0
    strict_reference: bool = False

    def __post_init__(self) -> None:
        if self.limit <= 0:
            raise ValueError("limit must be positive")
        if not 0 <= self.semantic_weight <= 1 or not 0 <= self.alpha <= 1:
            raise ValueError("weights lie within 0 and 1")
        if self.rrf_k <= 0:
            raise ValueError("rrf_k must be positive")


def strategy(name: str, weight: float = 0.7) -> float:
    """Semantic weight of a named strategy."""
    return {"bm25Only": 0.0, "semanticOnly": 1.0, "hybrid": weight}[name]
