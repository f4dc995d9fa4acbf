import pytest

from quarrylight.functions import answers
from quarrylight.functions.columns import glob_regex
from quarrylight.plans.query import SearchOptions, camel_terms, conformance_target, intent, is_camel_case, is_conceptual, prepared_match, query_terms, raw_match, snippet_match, strategy
import re


@pytest.mark.parametrize(
    "path, pattern, wanted",
    [
        ("/src/file.swift", "*.swift", True),
        ("/src/file.txt", "*.swift", False),
        ("/src/deep/nested/file.swift", "**/file.swift", True),
        ("/file.swift", "**/file.swift", True),
        ("/src/utils/helpers.swift", "**/utils/*.swift", True),
        ("/src/models/user.swift", "**/utils/*.swift", False),
        ("/src/file1.swift", "/src/file?.swift", True),
        ("/src/file10.swift", "/src/file?.swift", False),
        ("Sources/Auth/a.swift", "Sources/**", True),
    ],
)
def test_globs(path, pattern, wanted):
    assert bool(re.match(glob_regex(pattern), path)) is wanted


def test_strict_glob_rewrites_its_own_output():
    assert glob_regex("**/auth/*.swift", True) == r"^(.[^/]*/).auth/[^/]*\.swift$"


def test_match_grammar():
    m = prepared_match("find ChunkStore in db")
    assert m.every and [(p.tokens, p.prefix) for p in m.phrases] == [(("find",), True), (("chunkstore",), False), (("in",), False), (("db",), False)]
    m = prepared_match("foo_bar baz")
    assert not m.every and [(p.tokens, p.prefix) for p in m.phrases] == [(("foo", "bar"), True), (("baz",), True)]
    assert prepared_match("foo_bar baz", False).every
    for odd in ("", "()", "C++", "?*", "'", "a.b,c", "OR AND", 'say "hi"', "\\"):
        prepared_match(odd), raw_match(odd), snippet_match(odd)
    assert prepared_match("?? **").phrases == ()
    assert snippet_match('"install" "guide"*').every and not snippet_match("install guide").every


def test_words():
    assert is_camel_case("Find") and is_camel_case("ChunkStore") and not is_camel_case("find") and not is_camel_case("URL") and not is_camel_case("Ab")
    assert query_terms("what implements the ChunkStore protocol?") == ["ChunkStore"]
    assert camel_terms("how does ChunkStore work") == ["ChunkStore"]
    assert is_conceptual("How is it done") and is_conceptual("vector search") and not is_conceptual("ChunkStore")


def test_intent():
    found = intent("what implements ChunkStore")
    assert found.implementation and found.types == ["ChunkStore"] and found.reranks
    assert intent("protocol for a class").kinds == ["protocol", "class"]
    assert not intent("plain words").reranks
    assert conformance_target("what implements ChunkStore") == "ChunkStore"
    assert conformance_target("what implements ChunkStore", True) == "Chunkstore"
    assert conformance_target("ChunkStore") is None


def test_options():
    for bad in ({"limit": 0}, {"semantic_weight": 1.5}, {"rrf_k": 0}, {"alpha": -1}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)
    assert strategy("bm25Only") == 0 and strategy("semanticOnly") == 1 and strategy("hybrid") == 0.7


def test_expansion():
    e = answers.parse_expansion("SYNONYMS: a, b\nrelated: c\nVariations: d", "q")
    assert (e.synonyms, e.related, e.variations) == (["a", "b"], ["c"], ["d"]) and e.combined == "q a b c d"
    assert answers.parse_expansion("x, y\nz, w", "q").related == ["w"]

    def fails(_):
        raise OSError

    assert answers.expand("q", fails).terms == ["q"]


def test_synthesis():
    s = answers.parse_synthesis("SUMMARY: One.\nTwo.\nINSIGHTS:\n- first\n• second\nREFERENCES:\n- a.swift:12 - why\nb.swift\nCONFIDENCE: 85%")
    assert s.summary == "One. Two." and s.insights == ["first", "second"] and s.references == [("a.swift", 12, "why"), ("b.swift", None, None)] and s.confidence == 0.85
    assert answers.parse_synthesis("just words").summary == "just words" and answers.parse_synthesis("CONFIDENCE: 300").confidence == 1.0


def test_render():
    rows = [{"path": "a", "start_line": 1, "kind": "class", "relevance_percent": 9, "content": "x\ny"}]
    assert answers.render(rows, "json").startswith("[") and answers.render(rows).startswith("1. a:1 [class] 9%") and answers.render(rows, "toon").startswith("results[1]{")


def test_sections_of_a_synthesis_in_any_order():
    s = answers.parse_synthesis("First line.\nSecond.\nCONFIDENCE: 80\nREFERENCES:\n- a.swift\n- b.swift:x\n- :3\ninsights:\nno bullet\n- \n- yes")
    assert (s.summary, s.insights, s.references, s.confidence) == ("First line.", ["yes"], [("a.swift", None, None), ("b.swift", None, None)], 0.8)
    assert answers.parse_synthesis("SUMMARY: a\nCONFIDENCE: 50%\nb").summary == "a b" and answers.parse_synthesis("CONFIDENCE: high").confidence == 0.7
    assert answers.parse_reference("• x/y.swift:12:3 - why - not") == ("x/y.swift", 12, "why") and answers.parse_synthesis("  ").summary == ""


def test_operators_that_ask_a_model(spark):
    def broken(*_):
        raise OSError("down")

    rows = [{"path": "a.swift", "start_line": 3, "content": "x"}]
    assert answers.synthesize("q", rows, lambda t: "SUMMARY: all of it" if "a.swift:3" in t else "").summary == "all of it"
    assert answers.synthesize("q", rows, broken).references == [("a.swift", 3, None)]
    assert answers.follow_ups("q", "s", lambda _: '1. How is it tested?\n- "where used"\nx\n2) How is it tested?\n\nq') == ["How is it tested?", "where used"] and answers.follow_ups("q", "s", broken) == []
    chunks = spark.createDataFrame([("1", "func a()"), ("2", None), ("3", "")], "id string, content string")
    said = answers.describe(chunks, lambda texts: ["This function does " + t if t else None for t in texts]).collect()
    assert {r["id"]: r["generated_description"] for r in said} == {"1": "Does func a().", "2": None, "3": None}
    assert {r["generated_description"] for r in answers.describe(chunks, broken).collect()} == {None}
