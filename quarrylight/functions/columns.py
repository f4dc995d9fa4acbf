"""Column expressions: paths, globs, tokens, percentages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"

# Language of a chunk and of a snippet by file extension.
CHUNK_LANGUAGES = {"swift": "swift", "m": "objective-c", "mm": "objective-c", "h": "c-header", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown"}
SNIPPET_LANGUAGES = {"md": "markdown", "markdown": "markdown", "rst": "restructuredtext", "txt": "text", "swift": "swift", "m": "objective-c", "mm": "objective-c", "h": "c-header"}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def first_tokens(text: Column, n: int) -> Column:
    """tokens(), but only the first n are sure to be there: one token more is cut off before the text is put in lower case, since a letter's lower case may depend on the next word."""
    return tokens(F.regexp_extract(text, r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,%d}" % (n + 1), 0))


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column, table: dict[str, str] = CHUNK_LANGUAGES) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(known[extension(path)], F.lit("unknown"))


def glob_regex(pattern: str, strict_reference: bool = False) -> str:
    """A regular expression for a whole path.

    `**/` is any number of folders, `**` anything, `*` and `?` stay within one segment; a pattern without a slash
    matches the last segment. strict_reference: five replacements, each over the result of the one before."""
    if strict_reference:
        for a, b in ((".", r"\."), ("**/", "(.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", ".")):
            pattern = pattern.replace(a, b)
        return f"^{pattern}$"
    body = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.escape(m[0]), pattern)
    return f"^{'' if '/' in pattern else '(?:.*/)?'}{body}$"


def matches_glob(path: Column, pattern: str, strict_reference: bool = False) -> Column:
    """A pattern that isn't a valid expression matches nothing."""
    text = glob_regex(pattern, strict_reference)
    try:
        re.compile(text)
    except re.error:
        return F.lit(False)
    return path.rlike(text)


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    wanted = [e.lower().lstrip(".") for e in extensions]
    return extension(path).isin(wanted) if wanted else F.lit(True)


def search_percent(score: Column, semantic_score: Column) -> Column:
    """A hundred times the semantic score if there is one (not bounded), else of the score against 0.0164."""
    return F.when(semantic_score.isNotNull(), F.floor(semantic_score * 100)).otherwise(F.floor(F.least(score / 0.0164, F.lit(1.0)) * 100)).cast("int")


def snippet_percent(score: Column) -> Column:
    return (F.least(score / 25, F.lit(1.0)) * 100).cast("int")


def recall_boost(terms: Column) -> Column:
    """1 + (min(n, 10) - 1) / 9."""
    return 1 + (F.least(terms, F.lit(10)) - 1) / 9


def token_estimate(content: Column) -> Column:
    return F.floor(F.length(content) / 4).cast("int")


def truncate_tokens(content: Column, limit: int) -> Column:
    return F.when(F.length(content) > 4 * limit, F.concat(F.left(content, F.lit(4 * limit)), F.lit("..."))).otherwise(content)


def json_strings(text: Column) -> Column:
    """An array of strings from JSON text; what isn't one is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def identifier(*parts: Column) -> Column:
    """32 hexadecimal digits of the SHA-256 of the parts joined by colons: the same on each run."""
    return F.left(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), F.lit(32))


def hop_score(score: Column, depth: int) -> Column:
    return score * F.lit(0.7**depth)


# Categories of follow-up queries, in order.
FOLLOW_UPS = (("how|usage|example", "howTo"), ("why|reason", "deeperUnderstanding"), ("test|spec", "testing"), ("similar|related|like", "relatedCode"), ("config|setup|init", "configuration"))


def follow_up(query: Column) -> Column:
    out = F.lit("exploration")
    for pattern, name in reversed(FOLLOW_UPS):
        out = F.when(query.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


# Openings that a description drops.
DESCRIPTION_OPENINGS = ("This code ", "This function ", "This method ", "This class ", "This struct ", "This enum ", "This protocol ", "Description: ", "Summary: ")


def clean_description(text: Column, most: int = 250) -> Column:
    """Without one known opening, capitalised, ending in a mark, and cut at a sentence or word within `most` characters."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^(?:" + "|".join(DESCRIPTION_OPENINGS) + ")", "")
    body = F.concat(F.upper(F.left(body, F.lit(1))), F.substr(body, F.lit(2)))
    body = F.when(body.rlike(r"[.!?]$"), body).otherwise(F.concat(body, F.lit(".")))
    head = F.left(body, F.lit(most))
    sentence, word = F.regexp_extract(head, r"^([\s\S]*\.)", 1), F.regexp_extract(head, r"^([\s\S]*) ", 1)
    return F.when(F.length(body) <= most, body).when(sentence != "", sentence).when(head.contains(" "), F.concat(word, F.lit("..."))).otherwise(body)
