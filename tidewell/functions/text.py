"""Text expressions: Column to Column, all of built-in functions.

Lengths called bytes are of UTF-8, lengths called runes are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP_BYTES = 8192
REASON_BYTES = 1000
ELLIPSIS = "…"
TRUNCATED = "\n\n[truncated]"
PATH_SEPARATOR = " > "

#: Code points that count as two thirds of a token each.
CJK_RANGES = [
    (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF),
]
_CJK = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"


def _text(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def estimate_tokens(text, drift: bool = False) -> Column:
    """Estimated tokens: a CJK rune counts 1/1.5, another 1/4, rounded up.

    The exact rational by default; `drift` sums doubles one rune at a time and may round up one more.
    """
    text = _text(text)
    if drift:
        weight = lambda c: F.when(c.rlike(_CJK), F.lit(1 / 1.5)).otherwise(F.lit(0.25))
        runes = F.filter(F.split(text, ""), lambda c: c != "")
        return F.ceil(F.aggregate(F.transform(runes, weight), F.lit(0.0), lambda a, b: a + b)).cast("long")
    other = F.char_length(F.regexp_replace(text, _CJK, ""))
    cjk = F.char_length(text) - other
    return F.ceil((8 * cjk + 3 * other) / 12).cast("long")


def message_tokens(*parts) -> Column:
    """Estimated tokens of a chat message: a quarter of the bytes of its parts, rounded up."""
    return F.ceil(reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(_text(p)), F.lit(0)) for p in parts]) / 4).cast("long")


def worst_case_prompt(steps, overhead_bytes) -> Column:
    return F.floor((_text(steps) * CAP_BYTES + _text(overhead_bytes)) / 4).cast("long")


def normalize(content) -> Column:
    """Text of a BINARY column: null unless UTF-8; CRLF becomes LF, one leading byte-order mark goes."""
    text = F.decode(_text(content), "UTF-8")
    text = F.when(F.is_valid_utf8(_text(content).cast("string")), text)
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2147483647)).otherwise(text)


def heading_path(titles) -> Column:
    return F.array_join(F.filter(_text(titles), lambda t: t != ""), PATH_SEPARATOR)


def embedded_text(path, body) -> Column:
    """What is embedded for a chunk: its path, a blank line and its body, or the body alone."""
    return F.when(F.coalesce(_text(path), F.lit("")) == "", _text(body)).otherwise(F.concat_ws("\n\n", _text(path), _text(body)))


def join_units(units) -> Column:
    """Join ARRAY<STRUCT<text, tight>>: a line feed between two tight units, else a blank line."""
    return F.aggregate(
        _text(units),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("tight"), F.lit(0).alias("n")),
        lambda a, u: F.struct(
            F.when(a["n"] == 0, u["text"]).otherwise(F.concat(a["text"], F.when(a["tight"] & u["tight"], F.lit("\n")).otherwise(F.lit("\n\n")), u["text"])).alias("text"),
            u["tight"].alias("tight"), (a["n"] + 1).alias("n"),
        ),
        lambda a: a["text"],
    )


def render_section(level, title, body) -> Column:
    head = F.concat(F.repeat(F.lit("#"), _text(level)), F.lit(" "), _text(title))
    return F.concat_ws("\n\n", head, F.when(_text(body) != "", _text(body)))


def chunk_id(document_id, index) -> Column:
    return F.concat_ws("-", _text(document_id).cast("string"), _text(index).cast("string"))


def byte_prefix(text, most: int) -> Column:
    """The longest prefix of at most `most` bytes that ends between two runes."""
    raw = F.encode(_text(text), "UTF-8")
    cuts = F.array(*[F.substring(raw, 1, most - i) for i in range(4)])
    whole = F.element_at(F.filter(cuts, lambda x: F.is_valid_utf8(x.cast("string"))), 1)
    return F.when(F.octet_length(_text(text)) <= most, _text(text)).otherwise(whole.cast("string"))


def cap(text, most: int = CAP_BYTES) -> Column:
    """STRUCT<text, bytes, truncated>: the text within `most` bytes, and its size before the cut."""
    text = _text(text)
    return F.struct(byte_prefix(text, most).alias("text"), F.octet_length(text).cast("long").alias("bytes"), (F.octet_length(text) > most).alias("truncated"))


def envelope(text) -> Column:
    """The text within CAP_BYTES, the marker of a cut included."""
    text = _text(text)
    return F.when(F.octet_length(text) <= CAP_BYTES, text).otherwise(F.concat(byte_prefix(text, CAP_BYTES - len(TRUNCATED)), F.lit(TRUNCATED)))


def failure_reason(text) -> Column:
    text = _text(text)
    return F.when(F.octet_length(text) <= REASON_BYTES, text).otherwise(F.concat(byte_prefix(text, REASON_BYTES), F.lit(ELLIPSIS)))


def blank_to_null(text) -> Column:
    return F.nullif(_text(text), F.lit(""))


def format_value(value) -> Column:
    """Six significant digits without trailing zeros, exponent form below 1e-4 and from 1e6 on."""
    v = _text(value).cast("double")
    scientific = F.format_string("%.5e", v)
    power = F.substring_index(scientific, "e", -1).cast("int")
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    plain = reduce(lambda c, k: c.when(power == k, bare(F.format_string(f"%.{5 - k}f", v))), range(-3, 6), F.when(power == -4, bare(F.format_string("%.9f", v))))
    parts = F.concat(bare(F.substring_index(scientific, "e", 1)), F.lit("e"), F.substring_index(scientific, "e", -1))
    return (
        F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(v == 0, "0").otherwise(F.coalesce(plain, parts))
    )


#: Escapes with a letter of their own.
_LETTERS = {"\\": "\\\\", '"': '\\"', "\x07": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\x0b": "\\v"}
_HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"


def quoted(text) -> Column:
    """A double-quoted literal: backslash escapes for quotes, controls and what can't be seen."""
    out = _text(text)
    for a, b in _LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    code = lambda c: F.ascii(c)
    shown = lambda c: F.when(code(c) < 128, F.format_string("\\x%02x", code(c))).when(code(c) < 65536, F.format_string("\\u%04x", code(c))).otherwise(F.format_string("\\U%08x", code(c)))
    each = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(_HIDDEN), shown(c)).otherwise(c)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(_HIDDEN), each).otherwise(out), F.lit('"'))


#: Fixed values.
ULID_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(number: Column, digits: int) -> Column:
    places = F.sequence(F.lit(digits - 1), F.lit(0))
    digit = lambda i: F.call_function("shiftrightunsigned", number, (5 * i).cast("int")).bitwiseAND(31)
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit(ULID_ALPHABET), (digit(i) + 1).cast("int"), F.lit(1))), "")


def ulid(at, *entropy) -> Column:
    """A ULID: the time in milliseconds, then 80 bits that follow from the entropy columns."""
    ms = F.unix_millis(_text(at))
    return F.concat(_base32(ms, 10), *[_base32(F.xxhash64(F.lit(salt), ms, *[_text(e) for e in entropy]), 8) for salt in (1, 2)])


def render_labels(labels, name: str = "__name__") -> Column:
    """name{k="v",...} with keys in order; {} for an empty set."""
    labels = _text(labels)
    pairs = F.filter(F.array_sort(F.map_entries(labels)), lambda e: e["key"] != name)
    inner = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"]))), ",")
    return F.when(F.size(labels) == 0, F.lit("{}")).otherwise(F.concat(F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit("")), F.lit("{"), inner, F.lit("}")))


def render_record(ts, level, msg, attrs) -> Column:
    """time level msg k=v ..., keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(_text(attrs))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(" ", F.date_format(_text(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), _text(level), _text(msg), F.nullif(F.array_join(pairs, " "), F.lit("")))


def records_header(service, matched, returned, unparseable) -> Column:
    return F.concat(
        F.format_string("%s: %d matching records", _text(service), _text(matched)),
        F.when(_text(returned) < _text(matched), F.format_string(", showing the last %d", _text(returned))).otherwise(""),
        F.when(_text(unparseable) > 0, F.format_string("; %d unparseable lines skipped", _text(unparseable))).otherwise(""),
    )


def hit_header(document_id, source, path, score) -> Column:
    return F.concat(
        F.format_string("[%s] %s", _text(document_id).cast("string"), _text(source)),
        F.when(F.coalesce(_text(path), F.lit("")) != "", F.concat(F.lit(" · "), _text(path))).otherwise(""),
        F.format_string(" (%.2f)", _text(score)),
    )


def content_sha256(content) -> Column:
    return F.sha2(_text(content), 256)


def first_line(text, most: int = 90) -> Column:
    """The first line, trimmed; over `most` bytes it is cut and gets an ellipsis."""
    line = F.rtrim(F.substring_index(F.regexp_replace(_text(text), r"^\s+|\s+$", ""), "\n", 1))
    return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(byte_prefix(line, most), F.lit(ELLIPSIS)))


def one_paragraph(text) -> Column:
    return F.trim(F.regexp_replace(_text(text), r"\s+", " "))


def rounded_seconds(seconds) -> Column:
    """To 10 ms from a second on, to a millisecond from one on, else to 10 microseconds."""
    s = _text(seconds)
    return F.when(s >= 1, F.round(s, 2)).when(s >= 0.001, F.round(s, 3)).otherwise(F.round(s, 5))


def action_json(tool, arguments) -> Column:
    return F.to_json(F.struct(_text(tool).alias("tool"), _text(arguments).alias("arguments")))


def finish_payload(value) -> Column:
    """STRUCT<root_cause, affected_service, next_actions, evidence> of a finish payload in JSON.

    A bare string of next_actions becomes an array of one; citations that can't be read are left out one by one.
    """
    v = F.try_parse_json(_text(value))
    actions = F.coalesce(
        F.try_variant_get(v, "$.next_actions", "array<string>"),
        F.when(F.schema_of_variant(F.try_variant_get(v, "$.next_actions", "variant")) == "STRING", F.array(F.try_variant_get(v, "$.next_actions", "string"))),
        F.array().cast("array<string>"),
    )
    raw = F.coalesce(F.try_variant_get(v, "$.evidence", "array<variant>"), F.array().cast("array<variant>"))
    cite = F.transform(
        F.filter(raw, lambda e: F.try_variant_get(e, "$.step", "int").isNotNull()),
        lambda e: F.struct(
            F.try_variant_get(e, "$.step", "int").alias("step"), F.try_variant_get(e, "$.note", "string").alias("note"),
            F.try_variant_get(e, "$.document_id", "string").alias("document_id"),
        ),
    )
    return F.struct(
        F.try_variant_get(v, "$.root_cause", "string").alias("root_cause"), F.try_variant_get(v, "$.affected_service", "string").alias("affected_service"),
        actions.alias("next_actions"), cite.alias("evidence"),
    )


def filename_format(name) -> Column:
    """markdown or text for an acceptable file name, else null: a bare name of at most 255 runes."""
    n = _text(name)
    fine = (F.char_length(n) <= 255) & (F.char_length(n) > 0) & ~n.rlike(r"[/\\\x00]") & ~n.isin(".", "..")
    ext = F.lower(F.regexp_extract(n, r"(\.[^.]*)$", 1))
    return F.when(fine & (ext == ".md"), "markdown").when(fine & (ext == ".txt"), "text")


def is_ulid(value) -> Column:
    return _text(value).rlike(r"^[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}$")


def is_request_id(value) -> Column:
    return _text(value).rlike(r"^[A-Za-z0-9._-]{1,128}$")


def is_service(value) -> Column:
    return _text(value).rlike(r"^[a-z0-9][a-z0-9-]{0,63}$")


def field_errors(rules: dict[str, list[tuple[Column, str]]]) -> Column:
    """MAP<field, code> of each field's first broken rule; rules: field -> [(is broken, code)]."""
    first = [F.struct(F.lit(f).alias("key"), F.coalesce(*[F.when(bad, F.lit(code)) for bad, code in checks]).alias("value")) for f, checks in rules.items()]
    return F.map_from_entries(F.filter(F.array(*first), lambda e: e["value"].isNotNull()))


def required_text(field: str, most: int) -> list[tuple[Column, str]]:
    c = F.trim(F.coalesce(F.col(field), F.lit("")))
    return [(c == "", "required"), (F.char_length(c) > most, "too_long")]


def optional_text(field: str, most: int) -> list[tuple[Column, str]]:
    return [(F.char_length(F.coalesce(F.col(field), F.lit(""))) > most, "too_long")]


def one_of(field: str, values: list[str]) -> list[tuple[Column, str]]:
    return [(~F.coalesce(F.col(field).isin(values), F.lit(False)), "invalid")]


def probe_path(path) -> Column:
    """A path that joins to a base without changing its host, else null."""
    p = _text(path)
    fine = p.startswith("/") & ~p.startswith("//") & ~p.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~p.rlike(r"[\x00-\x20\\]")
    return F.when(fine, p)


def tool_status(kind, refused) -> Column:
    return F.when(_text(refused), "REFUSED").when(_text(kind) == "timeout", "TIMEOUT").when(F.coalesce(_text(kind), F.lit("")) == "", "OK").otherwise("ERROR")


#: Fixed values.
STATUS_OF_KIND = {"invalid": 400, "not_found": 404, "conflict": 409, "gone": 410, "too_large": 413, "unsupported": 415, "unavailable": 503, "timeout": 504}


def http_status(kind) -> Column:
    return reduce(lambda c, kv: c.when(_text(kind) == kv[0], kv[1]), STATUS_OF_KIND.items(), F.when(F.lit(False), 0)).otherwise(500)


def is_retryable(status) -> Column:
    s = _text(status)
    return (s == 0) | (s == 408) | (s == 429) | s.between(500, 599)


def retry_delay(attempt, retry_after=None) -> Column:
    """Seconds: 0.5 doubled with each attempt, or what the server asks for, at most 10."""
    own = 0.5 * F.pow(F.lit(2.0), _text(attempt) - 1)
    return F.least(F.coalesce(_text(retry_after).cast("double"), own) if retry_after is not None else own, F.lit(10.0))


def sse_frame(event_id, event, data) -> Column:
    return F.format_string("id: %s\nevent: %s\ndata: %s\n\n", _text(event_id), _text(event), _text(data))


def resume_after(last_event_id) -> Column:
    """The id to resume after, or the start for one that isn't <ms>-<seq>."""
    return F.when(_text(last_event_id).rlike(r"^\d+-\d+$"), _text(last_event_id)).otherwise("0-0")


def wire_time(ts) -> Column:
    return F.date_format(_text(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


RFC3339 = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def parse_rfc3339(text) -> Column:
    """A TIMESTAMP, or null for anything that isn't RFC 3339 (a bare date, say)."""
    return F.when(_text(text).rlike(RFC3339), F.try_to_timestamp(F.upper(_text(text))))


def incident_message(title, service, description) -> Column:
    """The first message of an investigation: title, service if there is one, description if it says more than white space."""
    body = F.trim(F.coalesce(_text(description), F.lit("")))
    return F.concat(
        F.lit("Incident: "), _text(title), F.when(F.coalesce(_text(service), F.lit("")) != "", F.concat(F.lit("\nReported on: "), _text(service))).otherwise(""),
        F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""),
    )


def budget_message(step, max_steps, calls, max_calls) -> Column:
    """What is left of the budget; three degrees of urgency by the steps that remain."""
    left = _text(max_steps) - _text(step)
    urgency = F.when(left <= 0, "No step is left after this: finish.").when(left == 1, "One more step is left: finish unless it decides the matter.").otherwise(F.format_string("%d more steps are left.", left))
    return F.concat(F.format_string("Step %d/%d, tool calls %d/%d. ", _text(step), _text(max_steps), _text(calls), _text(max_calls)), urgency)


def forced_finish_message(bound) -> Column:
    return F.concat(F.lit("The run has met its bound "), _text(bound), F.lit(". Give your diagnosis from what you have seen."))


def observation_text(text) -> Column:
    return F.coalesce(F.nullif(F.trim(_text(text)), F.lit("")), F.lit("(no output)"))
