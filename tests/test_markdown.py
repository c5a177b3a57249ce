"""The block structure of Markdown: sections, units, and what chunks they give."""

import pytest

from tidewell.functions.markdown import sections
from tidewell.operators import chunking


def units(text):
    return [u for s in sections(text) for u in s[3]]


def heads(text):
    return [(level, title) for level, title, _, _ in sections(text)[1:]]


P, I = False, True  # noqa: E741


@pytest.mark.parametrize(
    "text,want",
    [
        # paragraphs and rules
        ("a\nb\n\nc", [("a\nb", P), ("c", P)]), ("a\n\n\n   b  \n", [("a", P), ("   b", P)]), ("a\n***\nb", [("a", P), ("b", P)]), ("a\n- - -\nb", [("a", P), ("b", P)]), ("a\n    not code", [("a\n    not code", P)]),
        # lists: an item is a unit; nested lists, paragraphs, code and lazy lines belong to it
        ("- a\n- b", [("- a", I), ("- b", I)]), ("* a\n+ b\n1. c\n2) d", [("* a", I), ("+ b", I), ("1. c", I), ("2) d", I)]), ("- a\n  - b\n    - c\n- d", [("- a\n  - b\n    - c", I), ("- d", I)]),
        ("- a\n\n  b\n\n- c\nlazy\n\nout", [("- a\n\n  b", I), ("- c\nlazy", I), ("out", P)]), ("- a\n\n not in it", [("- a", I), (" not in it", P)]), ("10. a\n\n    b", [("10. a\n\n    b", I)]), ("10. a\n\n   b", [("10. a", I), ("   b", P)]),
        ("a\n- b", [("a", P), ("- b", I)]), ("a\n2. b", [("a\n2. b", P)]), ("a\n1. b", [("a", P), ("1. b", I)]), ("a\n-\nb", [("b", P)]), ("-\n  a", [("  a", I)]), ("-\n\n  a", [("  a", P)]), ("- > a\nlazy", [("- > a\nlazy", I)]),
        ("- a\n  ***\n  b", [("- a\n  ***\n  b", I)]), ("-\ta", [("-\ta", I)]), ("-a", [("-a", P)]), ("1234567890. a", [("1234567890. a", P)]), ("- a\n\n      code\n\n- b", [("- a\n\n      code", I), ("- b", I)]),
        # fences: the same mark, as long or longer, closes; within containers the container's end does
        ("```\na\n~~~\n``\n```\nb", [("```\na\n~~~\n``\n```", P), ("b", P)]), ("~~~ py\na\n```\n~~~~", [("```py\na\n```\n```", P)]), ("````\na\n```\n````", [("```\na\n```\n```", P)]), ("```\na\n\n# b", [("```\na\n\n# b\n```", P)]),
        ("  ```\n  a\n b\n  ```", [("```\na\nb\n```", P)]), ("``` a`b\nc", [("``` a`b\nc", P)]), ("a\n```\nb\n```\nc", [("a", P), ("```\nb\n```", P), ("c", P)]), ("- a\n  ```\n  b\n\n  c\n  ```\n- d", [("- a\n  ```\n  b\n\n  c\n  ```", I), ("- d", I)]),
        ("- ```\n  a\nb", [("  a\nb", I), ("b", P)]), ("> ```\n> a\n\nb", [("> a", P), ("b", P)]), ("```\n```", [("```\n\n```", P)]),
        # quotes
        ("> a\nlazy\n> b\n\nc", [("> a\nlazy\n> b", P), ("c", P)]), ("> a\n\n> b", [("> a", P), ("> b", P)]), ("> - a\n> - b", [("> - a\n> - b", P)]), ("> a\n# b", [("> a", P)]), (">a\n> > b\nc", [(">a\n> > b\nc", P)]), ("> a\n---", [("> a", P)]),
        # indented code, whose last line holds its end
        ("    a\n      b\n\nc", [("    a\n      b", P), ("c", P)]), ("    a\n\n\n    b", [("    a\n\n\n    b", P)]), ("    a\nb", [("    a\nb", P), ("b", P)]), ("\ta", [("\ta", P)]),
        # HTML
        ("<div>\n*a*\n\nb", [("<div>\n*a*", P), ("b", P)]), ("<!-- a\n\nb -->\nc", [("<!-- a\n\nb -->", P), ("c", P)]), ("a\n<span>\nb", [("a\n<span>\nb", P)]), ("<span>\nb\n\nc", [("<span>\nb", P), ("c", P)]), ("<script>\na\n\nb</script>\nc", [("<script>\na\n\nb</script>", P), ("c", P)]),
        ("a\n<div>\nb", [("a", P), ("<div>\nb", P)]),
        # link definitions leave nothing
        ("[a]: /u", []), ("[a]: /u 't'\n[b]:\n  <v w>\nrest", [("rest", P)]), ("[a]: /u 't' x", [("[a]: /u 't' x", P)]), ("x\n[a]: /u", [("x\n[a]: /u", P)]), ("- [a]: /u\n\n  b", [("  b", I)]), ("[ ]: /u", [("[ ]: /u", P)]),
        # a table is a paragraph
        ("| a | b |\n| - | - |\n| 1 | 2 |\n\nc", [("| a | b |\n| - | - |\n| 1 | 2 |", P), ("c", P)]),
    ],
)
def test_units(text, want):
    assert units(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("# a\n## b ##\n### c #d\n#e\n####### f\n#", [(1, "a"), (2, "b"), (3, "c #d"), (1, "")]), ("   # a\n    # b", [(1, "a")]), ("## \n###   \n### ###", [(2, ""), (3, ""), (3, "")]), ("# a \\#", [(1, "a \\#")]), ("# a#", [(1, "a#")]),
        ("a\n===", [(1, "a")]), ("a\nb\n---", [(2, "a\nb")]), ("  a  \n  b\n  =", [(1, "a\nb")]), ("a\n= =", []), ("a\n\n===", []), ("===", []), ("- a\n===", []), ("- a\n  ===\nb", []), ("> a\n===", []), ("[a]: /u\n===\nb\n---", [(2, "===\nb")]),
        ("```\n# a\n```\n# b", [(1, "b")]), ("> # a\n\n- # b", []), ("a\n# b", [(1, "b")]), ("<div>\n# a\n\n# b", [(1, "b")]), ("-\n\n  a\n- \n", [(2, "a")]),
    ],
)
def test_headings(text, want):
    assert heads(text) == want


def test_paths():
    found = sections("p\n\n# A\n\n### C\n\n## B\n\n#\n\n## D\n\n# A\n\nx")
    assert [s[2] for s in found] == [[], ["A"], ["A", "C"], ["A", "B"], [], ["D"], ["A"]]
    assert found[0][3] == [("p", False)] and found[-1][3] == [("x", False)]


def chunks(spark, text, target=400, kind="markdown", most=2000):
    docs = spark.createDataFrame([("d", kind, text.encode() if isinstance(text, str) else text)], "document_id STRING, format STRING, content BINARY")
    made, rejected = chunking.chunk_documents(docs, target=target, most=most)
    return [(r["heading_path"], r["content"], r["tokens"]) for r in made.orderBy("chunk_index").collect()], [r["reason"] for r in rejected.collect()]


def test_a_table_over_the_budget_is_never_split(spark):
    table = "| service | setting | value |\n| --- | --- | --- |\n" + "| payment-service | connection pool size | 50 |\n" * 30
    found, _ = chunks(spark, "# Doc\n\n## Limits\n\n" + table + "\nAfter the table.\n", 40)
    assert len(found) == 2 and found[0][2] > 40 and found[0][1].count("| payment-service |") == 30 and "| --- | --- | --- |" in found[0][1]


def test_indented_code_keeps_its_indentation(spark):
    found, _ = chunks(spark, "# Doc\n\n    first: value\n      nested: value\n\nAfter.\n", 12)
    assert "    first: value\n      nested: value" in found[0][1]


def test_items_are_units_that_stay_lines(spark):
    found, _ = chunks(spark, "# Service\n\n## Checklist\n\n- restart the pool\n- check the dashboard\n")
    assert len(found) == 1 and "- restart the pool\n- check the dashboard" in found[0][1]
    many, _ = chunks(spark, "# Service\n\n## Checklist\n\n" + "".join(f"- step {k} of the list that is long\n  - with a part\n" for k in range(20)), 60)
    assert len(many) > 2 and all(t <= 60 for _, _, t in many) and sum(c.count("\n  - with a part") for _, c, _ in many) == 20


def test_a_fence_over_the_budget_is_one_unit(spark):
    code = "````go\n" + "// a line of code that goes on\n```\n" * 40 + "````"
    found, _ = chunks(spark, "# Service\n\n## Detail\n\n" + code + "\n\nA short trailing paragraph.\n", 60)
    assert len(found) == 2 and found[0][2] > 60 and "A short trailing paragraph." in found[1][1]


def test_underlined_headings_of_several_lines(spark):
    found, _ = chunks(spark, "Payment\nService\n=======\n\nOwns cards.\n\nLatency\n-------\n\nThe p99.\n")
    assert [p for p, _, _ in found] == ["Payment\nService", "Payment\nService > Latency"]


def test_windows_line_ends_and_marks(spark):
    lf = "# Service\n\n## Latency\n\n- Raise\n\n  the pool size.\n"
    assert chunks(spark, lf.replace("\n", "\r\n")) == chunks(spark, lf) == chunks(spark, "﻿" + lf)
    assert chunks(spark, b"# \xff\xfe\n")[1] == ["not UTF-8"]
    for text in ("", "   \n\n\t\n", "#\n", "[a]: /u\n"):
        assert chunks(spark, text) == ([], ["no content"])


def test_long_and_deep_documents(spark):
    deep = "".join("  " * k + "- x\n" for k in range(300))
    assert len(units(deep)) == 1 and units("> " * 500 + "x")[0][1] is False
    assert len(units("a\n\n" * 20_000)) == 20_000


def test_null_texts_and_other_keys(spark):
    docs = spark.createDataFrame([(1, None), (None, "a\n\nb"), (3, "")], "n LONG, text STRING")
    got = chunking.markdown_sections(docs, "n").collect()
    assert sorted((r["n"] is None, len(r["units"])) for r in got) == [(False, 0), (True, 2)]
