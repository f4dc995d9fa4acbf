"""Chunkers: texts to chunk rows.

JSON keys and YAML keys are columns (regexp_extract_all). Markdown sections, plain text packing and
the regular-expression languages need places in the text and run as Arrow-batched Python, one
document at a time, so that no lines are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.columns import extension, identifier
from quarrylight.session import small_batches

# Patterns of the languages, with the kind of chunk that a match gives.
_M = re.MULTILINE
OBJC = ((r"@implementation\s+(\w+)[\s\S]*?@end", 0, "class"), (r"^[-+]\s*\([^)]+\)\s*\w+[^{]*\{[\s\S]*?^\}", _M, "method"))
HEADER = (
    (r"@interface\s+(\w+)[\s\S]*?@end", 0, "interface"),
    (r"@protocol\s+(\w+)[\s\S]*?@end", 0, "protocol"),
    (r"^\w[\w\s\*]+\s+(\w+)\s*\([^)]*\)\s*;", _M, "function"),
    (r"typedef\s+struct\s*\w*\s*\{[\s\S]*?\}\s*(\w+)\s*;", 0, "struct"),
)
C = (
    (r"^[\w\s\*]+\s+(\w+)\s*\([^)]*\)\s*\{[\s\S]*?^\}", _M, "function"),
    (r"struct\s+(\w+)\s*\{[\s\S]*?\}\s*;", 0, "struct"),
    (r"typedef\s+struct\s*\w*\s*\{[\s\S]*?\}\s*(\w+)\s*;", 0, "struct"),
    (r"enum\s+(\w+)\s*\{[\s\S]*?\}\s*;", 0, "enum"),
)
CPP = (
    (r"class\s+(\w+)[\s\S]*?\{[\s\S]*?^\};", _M, "class"),
    (r"^[\w\s\*:&<>]+\s+(\w+::)?(\w+)\s*\([^)]*\)\s*(const)?\s*\{[\s\S]*?^\}", _M, "function"),
    (r"namespace\s+(\w+)\s*\{", 0, "namespace"),
)
JSON_KEY = r'(?m)^\s*"(\w+)"\s*:'
YAML_KEY = r"(?m)^(\w+):"
LANGUAGES = {"m": OBJC, "mm": OBJC, "h": HEADER, "c": C, "cpp": CPP, "cc": CPP, "cxx": CPP, "hpp": CPP}
WHOLE_IF_NONE = {"c", "cpp", "cc", "cxx", "hpp"}

CHUNK = "id string, path string, content string, start_line int, end_line int, kind string, symbols array<string>, references array<string>, doc_comment string, signature string, breadcrumb string, conformances array<string>, is_type_declaration boolean, error string"
_COLUMNS = ["id", "path", "content", "start_line", "end_line", "kind", "symbols", "references", "doc_comment", "signature", "breadcrumb", "conformances", "is_type_declaration", "error"]


def _id(*parts: object) -> str:
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:32]


def chunk(path: str, content: str, start: int, end: int, kind: str, name: str | None = None, **more) -> dict:
    row = dict.fromkeys(_COLUMNS) | {"path": path, "content": content, "start_line": start, "end_line": end, "kind": kind, "symbols": [name] if name else [], "references": [], "conformances": [], "is_type_declaration": False} | more
    row["id"] = row["id"] or _id(path, start, kind, content[:100])
    return row


def plain_text(path: str, content: str, most: int = 2000, strict_reference: bool = False) -> list[dict]:
    """Lines packed up to `most` characters; a longer line stands alone. strict_reference: start lines after the first are one too small."""
    if not content.strip():
        return []
    if len(content) <= most:
        return [chunk(path, content, 1, content.count("\n") + 1, "document")]
    lines = content.split("\n")
    ends = list(accumulate((len(line) + 1 for line in lines), initial=0))  # where each line begins in the text, and the end
    ends[-1] -= 1  # nothing breaks the last one
    out, first = [], 0
    while first < len(lines):
        last = max(first + 1, bisect_right(ends, ends[first] + most) - 1)
        body = content[ends[first] : ends[last]]
        if last < len(lines) or body.strip():
            out.append(chunk(path, body, first + (not strict_reference or not first), last, "document"))
        first = last
    return out


def _doc_comment(lines: list[str], line: int) -> str | None:
    """The run of comment lines that ends just above line (from 1), blank lines between skipped."""
    i, found = line - 2, []
    while i >= 0 and not lines[i].strip():
        i -= 1
    while i >= 0 and lines[i].strip().startswith("//"):
        found.append(re.sub(r"^/{2,3}\s?", "", lines[i].strip()))
        i -= 1
    return "\n".join(reversed(found)) or None


def by_patterns(path: str, content: str, patterns, whole_if_none: bool) -> list[dict]:
    lines, out = content.split("\n"), []
    for pattern, flags, kind in patterns:
        for m in re.finditer(pattern, content, flags):
            start = content.count("\n", 0, m.start()) + 1
            name = m[1] if m.re.groups else None
            first = m[0].strip("\n").split("\n")[0]
            out.append(chunk(path, m[0], start, start + m[0].count("\n"), kind, name, signature=first.split("{")[0].strip(), doc_comment=_doc_comment(lines, start)))
    if not out and whole_if_none and content.strip():
        out.append(chunk(path, content, 1, len(lines), "document"))
    return out


_DECLARATION = re.compile(
    r"(?P<mods>(?:(?:@\w+(?:\([^)]*\))?|public|private|internal|fileprivate|open|static|final|override|mutating|nonmutating|lazy|weak|indirect|required|convenience|nonisolated|async|package|distributed)(?:\(set\))?\s+)*)"
    r"(?P<word>class|struct|enum|protocol|extension|actor|func|init|deinit|subscript|typealias|macro|var|let)\b[?!]?\s*(?P<name>[\w.]*|`\w+`)"
)
_KIND = {"func": "function", "init": "initializer", "deinit": "deinitializer", "var": "variable", "let": "constant"}
_TYPES = ("class", "struct", "enum", "protocol", "actor", "extension")


def _blanked(text: str) -> str:
    """Comments and string literals as blanks of the same length, so that braces and words in them don't count."""
    return re.sub(r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"', lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def swift_nodes(content: str) -> list[dict]:
    """Declarations by braces and keywords: kind, name, place, parent. An approximation of a grammar: it knows no macros' expansions and no operators."""
    bare, nodes, open_ = _blanked(content), [], []
    depth, stack = 0, []
    places = sorted([(m.start(), "d", m) for m in _DECLARATION.finditer(bare) if m.start() == 0 or not (bare[m.start() - 1].isalnum() or bare[m.start() - 1] in "_.")] + [(i, c, None) for i, c in enumerate(bare) if c in "{}"], key=lambda x: (x[0], x[1] != "d"))
    for at, what, m in places:
        if what == "{":
            depth += 1
            while open_ and open_[-1]["open"] is None and not (open_[-1]["at"] < at):
                open_.pop()
            if open_ and open_[-1]["open"] is None and "\n\n" not in bare[open_[-1]["at"] : at] and not re.search(r"[;}]", bare[open_[-1]["at"] : at]):
                open_[-1]["open"], open_[-1]["depth"] = at, depth
                stack.append(open_.pop())
            else:
                stack.append(None)
        elif what == "}":
            depth -= 1
            if stack:
                node = stack.pop()
                if node:
                    node["end"] = at + 1
        else:
            word = m["word"]
            if word == "class" and re.match(r"\s*(func|var|let)\b", bare[m.end("word") :]):
                continue
            parents = [n for n in stack if n]
            line_end = bare.find("\n", m.end())
            node = {"word": word, "kind": _KIND.get(word, word), "name": m["name"].strip("`") or None, "at": m.start("mods") if m["mods"] else m.start("word"), "open": None, "end": line_end if line_end >= 0 else len(bare), "parents": parents}
            if word == "func" and parents and parents[-1]["word"] in _TYPES:
                node["kind"] = "method"
            nodes.append(node)
            open_ = [node]
    return nodes


def swift(path: str, content: str) -> list[dict]:
    """A chunk for each declaration, and one more, marked as declaration, for each type."""
    lines, bare, out = content.split("\n"), _blanked(content), []
    for n in swift_nodes(content):
        types = [p["name"] for p in n["parents"] if p["word"] in _TYPES and p["name"]]
        name = n["name"] or n["word"]
        full = ".".join([*types, name])
        start = content.count("\n", 0, n["at"]) + 1
        body = content[n["at"] : n["end"]]
        head = content[n["at"] : n["open"]] if n["open"] else body
        signature = " ".join(head.split())
        conforms = []
        if n["word"] in _TYPES and (m := re.search(r":\s*([^{]+?)(?:\bwhere\b|$)", " ".join(bare[n["at"] : n["open"] or n["end"]].split()))):
            conforms = [c.strip().split("<")[0] for c in m[1].split(",") if c.strip()]
        names = sorted(set(re.findall(r"\b[A-Za-z_]\w*\b", bare[n["at"] : n["end"]])) - {name} - set("class struct enum protocol extension actor func init deinit subscript typealias macro var let public private internal static final return if else for in while guard self async await try throws import override mutating nil true false".split()))
        common = {"references": names, "signature": signature, "doc_comment": _doc_comment(lines, start), "breadcrumb": " > ".join(types) or None, "conformances": conforms}
        out.append(chunk(path, body, start, start + body.count("\n"), n["kind"], id=_id(path, full, n["kind"], start), symbols=list(dict.fromkeys([full, name, *conforms])), **common))
        if n["word"] in _TYPES and (n["word"] != "extension" or conforms):
            out.append(chunk(path, signature, start, start, n["kind"], id=_id(path, f"{full}-decl", n["kind"], start), symbols=list(dict.fromkeys([full, name, *conforms])), is_type_declaration=True, **common))
    return out


def parse(path: str, content: str, strict_reference: bool = False) -> list[dict]:
    """Chunks of one file by its extension; an error is a row with nothing else, so that one file can't stop the others."""
    ext = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    try:
        if ext == "swift":
            out = swift(path, content)
        elif ext in LANGUAGES:
            out = by_patterns(path, content, LANGUAGES[ext], ext in WHOLE_IF_NONE)
        else:
            out = plain_text(path, content, strict_reference=strict_reference)
        return out or ([] if content.strip() else [chunk(path, "", 1, 1, "document", error="emptyContent")])
    except Exception as e:  # noqa: BLE001  whatever a file does, the next ones go on
        return [chunk(path, "", 1, 1, "document", error=repr(e))]


def parse_files(files: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Chunks of (path, content) for all extensions but markdown, JSON and YAML."""
    from quarrylight.session import ship

    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [c for p, t in zip(batch["path"], batch["content"], strict=True) for c in parse(p, t or "", strict_reference)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.filter(~extension(F.col("path")).isin("md", "markdown", "json", "yaml", "yml")).select("path", "content").mapInPandas(run, CHUNK)


def parse_all(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, snippets) of (path, content), whatever the extension. A markdown section is a chunk and a snippet that names the chunk; a markdown file without headings is one document."""
    none = lambda t: F.lit(None).cast(t)
    empty = F.array().cast("array<string>")
    more = {"references": empty, "doc_comment": none("string"), "signature": none("string"), "conformances": empty, "is_type_declaration": F.lit(False), "error": none("string")}
    keyed = key_documents(files).withColumns({"id": identifier(F.col("path"), F.lit(1), F.col("kind")), "start_line": F.lit(1), "end_line": F.size(F.split("content", "\n", -1)), "breadcrumb": none("string")} | more)
    marked = markdown_sections(files.filter(extension(F.col("path")).isin("md", "markdown")))
    kind = F.when(F.col("title").isNull(), "document").otherwise("markdownSection")
    sections = marked.withColumns({"kind": kind, "id": identifier(F.col("path"), F.col("start_line"), kind, F.left("content", F.lit(100))), "symbols": F.when(F.col("title").isNull(), empty).otherwise(F.array("title"))} | more)
    chunks = parse_files(files).unionByName(keyed.select(*_COLUMNS)).unionByName(sections.select(*_COLUMNS))
    snippets = sections.select(identifier(F.lit("snippet"), F.col("id")).alias("id"), "path", "content", "start_line", "end_line", "breadcrumb", F.col("id").alias("chunk_id"), F.when(F.col("kind") == "document", "documentation").otherwise(F.col("kind")).alias("kind"))
    return chunks, snippets


def key_documents(files: DataFrame) -> DataFrame:
    """(path, kind, content, symbols): JSON and YAML files as one chunk, with their first 20 keys."""
    ext = extension(F.col("path"))
    keys = lambda pattern: F.slice(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), 1, 20)
    symbols = F.when(ext == "json", keys(JSON_KEY)).otherwise(keys(YAML_KEY))
    return files.filter(ext.isin("json", "yaml", "yml")).select("path", F.lit("document").alias("kind"), "content", symbols.alias("symbols"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """(path, section, title, level, breadcrumb, content, start_line, end_line) of (path, content).

    A line that starts with # opens a section; text before the first one is section 0 with null title. Sections that are blank don't count.
    The breadcrumb holds the titles that the section stands under, and its own; a title pops all those of its level or deeper."""
    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(_sections_of, SECTION)


SECTION = "path string, section long, title string, level int, breadcrumb string, content string, start_line int, end_line int"


def _sections(content: str) -> Iterator[tuple]:
    """(section, title, level, breadcrumb, content, start_line, end_line) of one text."""
    lines, above = content.split("\n"), []
    opens = [i for i, line in enumerate(lines) if line.startswith("#")]
    for section, (start, end) in enumerate(zip([0, *opens], [*opens, len(lines)], strict=True)):
        title, level = None, 0
        if section:
            rest = lines[start].lstrip("#")
            title, level = rest.strip(" "), len(lines[start]) - len(rest)
            above = [*above[: level - 1], title]
        body = "\n".join(lines[start:end])
        if start < end and body.strip(" \t\n\v\f\r"):
            yield section, title, level, " > ".join(above) if level else None, body, start + 1, end


def _sections_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in SECTION.split(", ")]
    for batch in batches:
        rows = [(path, *found) for path, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) if content is not None for found in _sections(content)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)


def syntax_tree(path_content: DataFrame) -> DataFrame:
    """Flattened tree rows (path, node_id, parent_id, depth, kind, name, start_line, end_line) of Swift files."""
    from quarrylight.session import ship

    ship(path_content.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                nodes = swift_nodes(content or "")
                number = {id(n): i for i, n in enumerate(nodes)}
                for i, n in enumerate(nodes):
                    start = content.count("\n", 0, n["at"]) + 1
                    rows.append((path, i, number[id(n["parents"][-1])] if n["parents"] else None, len(n["parents"]), n["kind"], n["name"], start, content.count("\n", 0, n["end"]) + 1))
            yield pd.DataFrame(rows, columns=["path", "node_id", "parent_id", "depth", "kind", "name", "start_line", "end_line"]).astype({"parent_id": "Int32"})

    return path_content.select("path", "content").mapInPandas(run, "path string, node_id int, parent_id int, depth int, kind string, name string, start_line int, end_line int")


def tree_view(nodes: DataFrame, most_depth: int | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Rows down to most_depth; with kinds, others go and their children move up to the nearest kept ancestor (as new depth)."""
    shown = nodes if most_depth is None else nodes.filter(F.col("depth") <= most_depth)
    if not kinds:
        return shown
    kept = shown.filter(F.col("kind").isin(list(kinds)))
    a, b = kept.alias("a"), kept.select("path", F.col("node_id").alias("up"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("depth").alias("d")).alias("b")
    inside = (F.col("a.path") == F.col("b.path")) & (F.col("b.d") < F.col("a.depth")) & (F.col("b.s") <= F.col("a.start_line")) & (F.col("b.e") >= F.col("a.end_line"))
    return a.join(b, inside, "left").groupBy("a.path", "a.node_id", "a.kind", "a.name", "a.start_line", "a.end_line").agg(F.max_by("up", "d").alias("parent_id"), F.count("up").alias("depth"))
