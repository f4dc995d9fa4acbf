"""Operators that ask a language model, parsers of its answers, and renderers. The model is a callable."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Expansion:
    query: str
    synonyms: list[str] = field(default_factory=list)
    related: list[str] = field(default_factory=list)
    variations: list[str] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return [self.query, *self.synonyms, *self.related, *self.variations]

    @property
    def combined(self) -> str:
        """For the full-text leg: joined by spaces, so all are required."""
        return " ".join(self.terms)


def _listed(text: str) -> list[str]:
    return [t for t in map(str.strip, text.split(",")) if t]


def parse_expansion(answer: str, query: str) -> Expansion:
    """SYNONYMS:, RELATED: and VARIATIONS: lines; if there are none, all terms by threes."""
    out = Expansion(query)
    sections = {"SYNONYMS:": out.synonyms, "RELATED:": out.related, "VARIATIONS:": out.variations}
    for line in map(str.strip, answer.splitlines()):
        for name, to in sections.items():
            if line.upper().startswith(name):
                to += _listed(line[len(name) :])
    if not (out.synonyms or out.related or out.variations):
        loose = [t for t in map(str.strip, answer.replace("\n", ",").split(",")) if t and len(t) < 100]
        for to, at in zip(sections.values(), (0, 3, 6), strict=True):
            to += loose[at : at + 3]
    return out


@dataclass
class Synthesis:
    summary: str = ""
    insights: list[str] = field(default_factory=list)
    references: list[tuple[str, int | None, str | None]] = field(default_factory=list)
    confidence: float = 0.7


_HEADING = re.compile(r"^[ \t]*(SUMMARY|INSIGHTS|REFERENCES):", re.IGNORECASE | re.MULTILINE)
_CONFIDENCE = re.compile(r"^[ \t]*CONFIDENCE:(.*)$", re.IGNORECASE | re.MULTILINE)
_NUMBER = re.compile(r"\s*(\d+(?:\.\d+)?)\s*%?\s*")
_BULLETS = "-•"


def _lines(text: str) -> list[str]:
    return [line for line in map(str.strip, text.split("\n")) if line]


def parse_reference(line: str) -> tuple[str, int | None, str | None] | None:
    """`path:line - description`, with or without a bullet."""
    place, dash, rest = line.removeprefix("-").removeprefix("•").strip().partition(" - ")
    path, _, number = place.partition(":")
    number = number.partition(":")[0]
    return (path, int(number) if number.isdecimal() else None, rest.partition(" - ")[0] if dash else None) if path else None


def parse_synthesis(answer: str) -> Synthesis:
    """SUMMARY:, INSIGHTS:, REFERENCES: and CONFIDENCE: sections, in any order. Without a summary it's the first line before all sections, without that the whole answer.

    A confidence is one line; others that stand where it is none belong to the section around it."""
    parts = _HEADING.split(_CONFIDENCE.sub("", answer))
    found: dict[str, list[str]] = {"SUMMARY": [], "INSIGHTS": [], "REFERENCES": []}
    for name, body in zip(parts[1::2], parts[2::2], strict=True):
        found[name.upper()].append(body)
    summary = next((" ".join(_lines(body)) for body in reversed(found["SUMMARY"]) if body.strip()), None)
    numbers = [float(m[1]) / 100 for m in map(_NUMBER.fullmatch, _CONFIDENCE.findall(answer)) if m]
    return Synthesis(
        summary or next(iter(_lines(parts[0])), "") or answer.strip(),
        [text for line in _lines("\n".join(found["INSIGHTS"])) if line[0] in _BULLETS and (text := line[1:].strip())],
        [ref for line in _lines("\n".join(found["REFERENCES"])) if (ref := parse_reference(line))],
        min(numbers[-1], 1.0) if numbers else 0.7,
    )


#: Fixed value: what a follow-up line must not be shorter than.
_SHORTEST_FOLLOW_UP = 4


def synthesize(query: str, results: list[dict], model: Callable[[str], str]) -> Synthesis:
    """The model's summary of search results; if it fails, how many results there are and where."""
    listed = "\n".join(f"- {r.get('path')}:{r.get('start_line')} {(r.get('content') or '')[:400]}" for r in results)
    try:
        return parse_synthesis(model(f"Summarise what these search results say about: {query}\n{listed}\nAnswer with\nSUMMARY: ...\nINSIGHTS:\n- ...\nREFERENCES:\n- path:line - why\nCONFIDENCE: percent"))
    except Exception:  # noqa: BLE001  search goes on without it
        return Synthesis(f"{len(results)} results for {query}", [], [(str(r.get("path")), r.get("start_line"), None) for r in results], 0.0)


def follow_ups(query: str, summary: str, model: Callable[[str], str], most: int = 5) -> list[str]:
    """Further queries that the model proposes, one a line, without numbers and bullets, none twice; none if it fails."""
    try:
        lines = _lines(model(f"Propose up to {most} further search queries, one a line.\nQuery: {query}\nFound: {summary}"))
    except Exception:  # noqa: BLE001  search goes on without it
        return []
    texts = (re.sub(r"^(?:[-•*]|\d+[.)])\s*", "", line).strip("\"' ") for line in lines)
    return list(dict.fromkeys(t for t in texts if len(t) >= _SHORTEST_FOLLOW_UP and t != query))[:most]


def describe(chunks: DataFrame, model: Callable[[list[str]], list[str | None]], most: int = 2000) -> DataFrame:
    """chunks with generated_description: the model's descriptions of their contents (cut to `most` characters for it), cleaned; null where it fails or says nothing. The model sees one batch at a time."""
    from quarrylight.functions.columns import clean_description

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            try:
                yield pd.Series(model([(t or "")[:most] for t in batch]), dtype=object)
            except Exception:  # noqa: BLE001  a batch that fails has no descriptions
                yield pd.Series([None] * len(batch), dtype=object)

    said = chunks.withColumn("generated_description", run("content"))
    return said.withColumn("generated_description", F.when(F.trim("generated_description") != "", clean_description(F.col("generated_description"))))


def expand(query: str, model: Callable[[str], str]) -> Expansion:
    """The model's expansion of a query; a model that fails leaves the query as it is."""
    try:
        return parse_expansion(model(f"List synonyms, related concepts and variations of this search query.\nSYNONYMS: ...\nRELATED: ...\nVARIATIONS: ...\nQuery: {query}"), query)
    except Exception:  # noqa: BLE001  search goes on without it
        return Expansion(query)


def render(rows: list[dict], style: str = "human", code_lines: int = 15, doc_chars: int = 150) -> str:
    """Results as text: human, json, or a table in one header line and tab-separated rows (toon)."""
    if style == "json":
        return json.dumps(rows, default=str)
    if style == "toon":
        names = list(rows[0]) if rows else []
        return "\n".join([f"results[{len(rows)}]{{{','.join(names)}}}:", *("\t".join(str(r[n]) for n in names) for r in rows)])
    out = []
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r.get('path')}:{r.get('start_line')} [{r.get('kind')}] {r.get('relevance_percent')}%")
        if r.get("doc_comment"):
            out.append(f"   {r['doc_comment'][:doc_chars]}")
        out += [f"   {line}" for line in (r.get("content") or "").split("\n")[:code_lines]]
    return "\n".join(out)
