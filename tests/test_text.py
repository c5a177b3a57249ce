"""Text expressions on golden values."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scoring
from tidewell.functions import text as T


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,tokens", [("", 0), ("word", 1), ("words", 2), ("数" * 12, 8), ("отказ", 2), ("café", 1), ("😀" * 4, 1), ("数" * 8 + "abcdefgh", 8), ("数" * 33, 22)])
def test_tokens(spark, text, tokens):
    assert value(spark, T.estimate_tokens("t"), t=text) == tokens


def test_tokens_drift(spark):
    assert value(spark, T.estimate_tokens("t", drift=True), t="数" * 33) == 23
    assert value(spark, T.estimate_tokens("t", drift=True), t="words") == 2


@pytest.mark.parametrize("text,most,kept", [("abc", 3, "abc"), ("abcd", 3, "abc"), ("aé", 2, "a"), ("é" * 5, 7, "é" * 3), ("😀😀", 7, "😀"), ("", 4, "")])
def test_cap_never_splits_a_rune(spark, text, most, kept):
    c = value(spark, T.cap("t", most), t=text)
    assert (c["text"], c["bytes"], c["truncated"]) == (kept, len(text.encode()), len(text.encode()) > most)


def test_envelope_and_reason(spark):
    out = value(spark, T.envelope("t"), t="é" * 5000)
    assert out.endswith(T.TRUNCATED) and len(out.encode()) <= 8192
    assert value(spark, T.failure_reason("t"), t="x" * 1001) == "x" * 1000 + "…"


def test_normalize(spark):
    assert value(spark, T.normalize("c"), c=bytearray("﻿﻿a\r\nb\rc".encode())) == "﻿a\nb\rc"
    assert value(spark, T.normalize("c"), c=bytearray(b"\xff\xfe")) is None


@pytest.mark.parametrize(
    "v,shown",
    [(1.0, "1"), (0.0, "0"), (1234567.0, "1.23457e+06"), (100000.0, "100000"), (0.0001, "0.0001"), (0.00001234, "1.234e-05"), (2.5, "2.5"), (-3.14159265, "-3.14159"), (float("nan"), "NaN"), (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (999999.5, "1e+06")],
)
def test_format_value(spark, v, shown):
    assert value(spark, T.format_value("v"), v=v) == shown


def test_labels(spark):
    m = F.create_map(F.lit("__name__"), F.lit("up"), F.lit("z"), F.lit('a"b'), F.lit("job"), F.lit("x"))
    assert value(spark, T.render_labels(m)) == 'up{job="x",z="a\\"b"}'
    assert value(spark, T.render_labels(F.create_map().cast("map<string,string>"))) == "{}"


def test_units(spark):
    u = lambda *p: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(g).alias("tight")) for t, g in p])
    assert value(spark, T.join_units(u(("a", True), ("b", True), ("c", False)))) == "a\nb\n\nc"


@pytest.mark.parametrize("name,form", [("a.md", "markdown"), ("A.TXT", "text"), ("a.pdf", None), ("x/a.md", None), ("a" * 253 + ".md", None), ("", None)])
def test_filename(spark, name, form):
    assert value(spark, T.filename_format("n"), n=name) == form


@pytest.mark.parametrize("text,fine", [("2026-09-21T10:00:00Z", True), ("2026-09-21T10:00:00.123+02:00", True), ("2026-09-21", False), ("now", False), ("2026-13-21T10:00:00Z", False)])
def test_rfc3339(spark, text, fine):
    assert (value(spark, T.parse_rfc3339("t"), t=text) is not None) == fine


def test_small_ones(spark):
    assert value(spark, T.is_ulid(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) and not value(spark, T.is_ulid(F.lit("81ARZ3NDEKTSV4RRFFQ69G5FAV")))
    assert value(spark, T.probe_path(F.lit("/a/b"))) == "/a/b" and value(spark, T.probe_path(F.lit("//evil"))) is None
    assert value(spark, T.one_paragraph(F.lit(" a \n b\tc "))) == "a b c"
    assert value(spark, T.first_line(F.lit("\nhead \nmore"))) == "head"
    assert value(spark, T.retry_delay(F.lit(3))) == 2.0 and value(spark, T.retry_delay(F.lit(9))) == 10.0
    assert value(spark, T.http_status(F.lit("conflict"))) == 409 and value(spark, T.http_status(F.lit("?"))) == 500
    assert value(spark, T.tool_status(F.lit(""), F.lit(True))) == "REFUSED" and value(spark, T.tool_status(F.lit("timeout"), F.lit(False))) == "TIMEOUT"
    assert value(spark, T.resume_after(F.lit("12-3"))) == "12-3" and value(spark, T.resume_after(F.lit("x"))) == "0-0"
    assert value(spark, T.heading_path(F.array(F.lit("A"), F.lit(""), F.lit("B")))) == "A > B"
    assert value(spark, T.embedded_text(F.lit("A"), F.lit("b"))) == "A\n\nb" and value(spark, T.embedded_text(F.lit(""), F.lit("b"))) == "b"
    assert value(spark, T.budget_message(F.lit(7), F.lit(8), F.lit(1), F.lit(6))).endswith("finish unless it decides the matter.")
    assert value(spark, T.wire_time(F.lit("2026-01-02 03:04:05.678901").cast("timestamp"))) == "2026-01-02T03:04:05.678901Z"
    assert value(spark, T.rounded_seconds(F.lit(1.23456))) == 1.23 and value(spark, T.rounded_seconds(F.lit(0.0012345))) == 0.001
    assert value(spark, T.sse_frame(F.lit("1-0"), F.lit("e"), F.lit("{}"))) == "id: 1-0\nevent: e\ndata: {}\n\n"


def test_finish_payload(spark):
    p = value(spark, T.finish_payload("j"), j='{"root_cause":"r","next_actions":"do it","evidence":[{"step":1,"note":"n"},"bad",{"document_id":"d"}]}')
    assert p["next_actions"] == ["do it"] and [(e["step"], e["note"]) for e in p["evidence"]] == [(1, "n")]
    assert value(spark, T.finish_payload("j"), j='{"next_actions":["a","b"]}')["next_actions"] == ["a", "b"]


@pytest.mark.parametrize(
    "text,term,rests",
    [("the pool is exhausted", "pool", True), ("it is not the pool", "pool", False), ("not the pool. " + "x" * 90 + " pool it is", "pool", True), ("nothing", "pool", False), ("é" * 50 + "no pool", "pool", False), ("not " + "é" * 50 + "pool", "pool", True)],
)
def test_rests_on(spark, text, term, rests):
    assert value(spark, scoring.rests_on(F.col("t"), F.lit(term)), t=text) is rests


def test_chunk_markdown_keeps_whole_lines(spark, tmp_path):
    from tidewell.plans import text as plans

    line = "a line that goes on and on " * 200
    spark.createDataFrame([(1, line), (2, "short"), (3, "\n".join([line] * 7)), (4, None)], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    rows = plans.chunk_markdown(spark, str(tmp_path)).collect()
    tokens = {k: sum(r["tokens"] for r in rows if r["doc_id"] == k) for k in (1, 2, 3)}
    assert tokens[1] >= len(line) // 4 and tokens[2] > 0 and tokens[3] >= 7 * (len(line) // 4)
