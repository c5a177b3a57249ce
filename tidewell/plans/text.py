"""Text scalars, validation and chunking over documents, pages and conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import chunking
from tidewell.plans.registry import query, table
from tidewell.sources import messages

_CJK = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in T.CJK_RANGES) + "]"
_TOKENS = "CAST(ceil((8 * (length(@) - length(regexp_replace(@, '" + _CJK + "', '', 'g'))) + 3 * length(regexp_replace(@, '" + _CJK + "', '', 'g'))) / 12.0) AS BIGINT)"


@query(f"SELECT doc_id, {_TOKENS.replace('@', 'text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query("""WITH b AS (SELECT doc_id, text, strlen(text) AS bytes FROM documents),
c AS (SELECT doc_id, bytes, CASE WHEN bytes <= 8192 THEN text ELSE list_reduce(list_prepend('', list_filter([left(text, CAST(k AS BIGINT)) FOR k IN range(4096, 8193)], lambda p: strlen(p) <= 8192)), lambda a, p: CASE WHEN strlen(p) > strlen(a) THEN p ELSE a END) END AS cut FROM b)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, bytes > 8192 AS truncated, CAST(strlen(cut) AS BIGINT) AS kept_bytes, md5(cut) AS kept FROM c""")
def byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", T.cap("text").alias("c"))
    return c.select("doc_id", "c.bytes", "c.truncated", F.octet_length("c.text").cast("long").alias("kept_bytes"), F.md5("c.text").alias("kept"))


@query("SELECT sha256(text) AS content_sha256, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def sha_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.content_sha256("text").alias("content_sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS paragraph FROM documents".replace("\\\\", "\\"))
def one_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.one_paragraph("text").alias("paragraph"))


@query("SELECT conv_id, turn, CAST(ceil((strlen(role) + strlen(text)) / 4.0) AS BIGINT) AS tokens FROM conversations")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.message_tokens("role", "text").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'required' WHEN length(trim(text)) > 4000 THEN 'too_long' END AS text_error,
  CASE WHEN lang IN ('en', 'de') THEN NULL ELSE 'invalid' END AS lang_error, regexp_matches(source, '^[a-z0-9][a-z0-9-]{0,63}$') AS service_ok FROM documents""")
def field_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = T.field_errors({"text": T.required_text("text", 4000), "lang": T.one_of("lang", ["en", "de"])})
    return table(spark, sf_dir, "documents").select("doc_id", errors.alias("e"), T.is_service("source").alias("service_ok")).select(
        "doc_id", F.try_element_at("e", F.lit("text")).alias("text_error"), F.try_element_at("e", F.lit("lang")).alias("lang_error"), "service_ok"
    )


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'poison_unknown' WHEN event_id % 5 = 1 THEN 'poison_known_id' ELSE 'ok' END AS disposition FROM events""")
def message_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ulid = F.concat(F.lit("01"), F.lpad(F.col("event_id").cast("string"), 24, "0"))
    good = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 1, 2).otherwise(1).alias("schema_version"), ulid.alias("document_id"), F.lit("x").alias("extra")))
    value = F.when(F.col("event_id") % 10 == 0, F.lit("{not json")).when(F.col("event_id") % 5 == 0, F.lit('{"schema_version":1,"document_id":"short"}')).otherwise(good)
    return messages.triage(e.select("event_id", value.alias("value")), "document_id").select("event_id", "disposition")


@query("""SELECT event_id, CASE WHEN exp >= 6 OR exp < -4 THEN NULL ELSE CAST(round(value * 1.5, 5 - exp) AS DOUBLE) END AS shown FROM (SELECT event_id, value, CAST(floor(log10(value * 1.5)) AS INTEGER) AS exp FROM events WHERE value > 0)""")
def value_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value > 0").select("event_id", T.format_value(F.col("value") * 1.5).cast("double").alias("shown"))


#: Documents whose every third sentence ends a paragraph, packed into chunks of 400 tokens: tables unit and chunk.
PACKED_SQL = f"""WITH RECURSIVE broken AS (SELECT doc_id, array_to_string(list_transform(string_split(text, '. '), lambda x, i: x || CASE WHEN i % 3 = 0 THEN '.' || chr(10) || chr(10) ELSE '. ' END), '') AS t FROM documents),
trimmed AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)) AS t FROM broken),
part AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(t, '\\n\\n+'), lambda x: trim(x, chr(10))), lambda x: x <> '')) AS p, generate_subscripts(list_filter(list_transform(regexp_split_to_array(t, '\\n\\n+'), lambda x: trim(x, chr(10))), lambda x: x <> ''), 1) AS i FROM trimmed),
unit AS (SELECT doc_id, i, p, 8 * (length(p) - length(regexp_replace(p, '{_CJK}', '', 'g'))) + 3 * length(regexp_replace(p, '{_CJK}', '', 'g')) AS w FROM part),
pack AS (SELECT doc_id, i, w AS used, 0 AS c FROM unit WHERE i = 1 UNION ALL
  SELECT u.doc_id, u.i, CASE WHEN used + 6 + u.w <= 4800 THEN used + 6 + u.w ELSE u.w END, CASE WHEN used + 6 + u.w <= 4800 THEN c ELSE c + 1 END FROM pack JOIN unit u ON u.doc_id = pack.doc_id AND u.i = pack.i + 1),
chunk AS (SELECT doc_id, c, string_agg(p, chr(10) || chr(10) ORDER BY i) AS content, count(*) AS units FROM pack JOIN unit USING (doc_id, i) GROUP BY 1, 2)"""


def paragraphs(docs: DataFrame) -> DataFrame:
    """docs whose every third sentence ends a paragraph."""
    ends = F.transform(F.split("text", r"\. "), lambda x, i: F.concat(x, F.when(i % 3 == 2, F.lit(".\n\n")).otherwise(F.lit(". "))))
    return docs.withColumn("text", F.array_join(ends, ""))


@query(PACKED_SQL + f" SELECT doc_id, CAST(c AS INTEGER) AS chunk_index, {_TOKENS.replace('@', 'content')} AS tokens, md5(content) AS content_md5 FROM chunk")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text in paragraphs of three sentences, packed under the budget."""
    docs = paragraphs(table(spark, sf_dir, "documents"))
    made = chunking.chunks(chunking.text_sections(docs, "doc_id"), "doc_id")
    return made.select("doc_id", "chunk_index", "tokens", F.md5("content").alias("content_md5"))


_W = "(8 * (length(@) - length(regexp_replace(@, '" + _CJK + "', '', 'g'))) + 3 * length(regexp_replace(@, '" + _CJK + "', '', 'g')))"
_LEVELS = [1, 2, 2, 3, 3]
_MARKDOWN_SQL = f"""WITH RECURSIVE line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
unit AS (SELECT doc_id, i // 6 AS k, i, regexp_replace('x' || raw, '[ \\t\\n]+$', '') AS t FROM line),
titled AS (SELECT doc_id, i // 6 AS k, ({_LEVELS})[CAST(i // 6 % 5 AS INTEGER) + 1] AS level, trim(regexp_replace(left('x' || raw, 40), '(^|[ \\t]+)#+[ \\t]*$', '')) AS title FROM line WHERE i % 6 = 0),
pathed AS (SELECT *, max(k) FILTER (WHERE level = 1) OVER w AS k1, max(k) FILTER (WHERE level = 2) OVER w AS k2 FROM titled WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
named AS (SELECT p.*, CASE p.level WHEN 1 THEN '' WHEN 2 THEN a.title ELSE a.title || ' > ' || b.title END AS parent FROM pathed p LEFT JOIN titled a ON a.doc_id = p.doc_id AND a.k = k1 LEFT JOIN titled b ON b.doc_id = p.doc_id AND b.k = k2),
weighed AS (SELECT doc_id, k, i, t, {_W.replace('@', 't')} AS w FROM unit),
body AS (SELECT doc_id, k, CAST(sum(w) + 6 * (count(*) - 1) AS BIGINT) AS bw, string_agg(t, chr(10) || chr(10) ORDER BY i) AS body FROM weighed GROUP BY 1, 2),
section AS (SELECT *, CASE WHEN parent = '' THEN title ELSE parent || ' > ' || title END AS own, CASE WHEN parent = '' THEN 0 ELSE {_W.replace('@', 'parent')} + 6 END AS pw, bw + 3 * (level + 1) + {_W.replace('@', 'title')} + 6 AS w,
  repeat('#', CAST(level AS INTEGER)) || ' ' || title || chr(10) || chr(10) || body AS whole FROM named JOIN body USING (doc_id, k)),
run AS (SELECT doc_id, k, CAST(w AS BIGINT) AS used, level, parent, 0 AS r FROM section WHERE k = 0 UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN goes THEN used + 6 + s.w ELSE s.w END, s.level, s.parent, CASE WHEN goes THEN r ELSE r + 1 END
  FROM (SELECT run.*, s.k AS k2, s.level = run.level AND s.parent = run.parent AND used + s.pw <= 4800 AND used + 6 + s.w + s.pw <= 4800 AS goes FROM run JOIN section s ON s.doc_id = run.doc_id AND s.k = run.k + 1) x JOIN section s ON s.doc_id = x.doc_id AND s.k = x.k2),
size AS (SELECT doc_id, r, count(*) AS n FROM run GROUP BY 1, 2),
lone AS (SELECT s.*, r, {_W.replace('@', 'own')} + 6 AS ow FROM section s JOIN run USING (doc_id, k) JOIN size USING (doc_id, r) WHERE n = 1),
pack AS (SELECT u.doc_id, u.k, r, ow, i, u.w AS used, 0 AS c FROM lone JOIN weighed u ON u.doc_id = lone.doc_id AND u.k = lone.k WHERE bw + ow > 4800 AND i % 6 = 0 UNION ALL
  SELECT u.doc_id, u.k, r, ow, u.i, CASE WHEN used + 6 + u.w + ow <= 4800 THEN used + 6 + u.w ELSE u.w END, CASE WHEN used + 6 + u.w + ow <= 4800 THEN c ELSE c + 1 END FROM pack JOIN weighed u ON u.doc_id = pack.doc_id AND u.k = pack.k AND u.i = pack.i + 1),
made AS (SELECT doc_id, r, 0 AS c, min(parent) AS path, string_agg(whole, chr(10) || chr(10) ORDER BY k) AS t FROM run JOIN section USING (doc_id, k, parent) JOIN size USING (doc_id, r) WHERE n > 1 GROUP BY 1, 2
  UNION ALL SELECT doc_id, r, 0, own, body FROM lone WHERE bw + ow <= 4800
  UNION ALL SELECT p.doc_id, p.r, p.c, min(own), string_agg(u.t, chr(10) || chr(10) ORDER BY u.i) FROM pack p JOIN weighed u USING (doc_id, k, i) JOIN lone USING (doc_id, k) GROUP BY 1, 2, 3),
chunk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r, c) - 1 AS INTEGER) AS chunk_index, path AS heading_path, CASE WHEN path = '' THEN t ELSE path || chr(10) || chr(10) || t END AS content FROM made)
SELECT doc_id, chunk_index, heading_path, {_TOKENS.replace('@', 'content')} AS tokens, md5(content) AS content_md5 FROM chunk"""


@query(_MARKDOWN_SQL)
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as Markdown: its lines are paragraphs, every sixth has its first characters as a heading above the whole line; a letter before each line keeps it from being anything else."""
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: _markdown_line(F.concat(F.lit("x"), x), i))
    made = chunking.chunks(chunking.markdown_sections(docs.select("doc_id", F.array_join(lines, "\n\n").alias("text")), "doc_id"), "doc_id")
    return made.select("doc_id", "chunk_index", "heading_path", "tokens", F.md5("content").alias("content_md5"))


def _markdown_line(line, i):
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), (F.floor(i / 6) % len(_LEVELS) + 1).cast("int"))
    return F.when(i % 6 == 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.substring(line, 1, 40), F.lit("\n\n"), line)).otherwise(line)


#: What a document's lines become, in turn; x stands for the line, with a letter before it.
_BLOCKS = ("@\\n@\\n===", "@\\n  @", "- @\\n\\n  > quoted\\nlazy", "- @\\n  1. inner\\nlazy", "````go\\n@\\n```\\n- none\\n````", "> @\\nlazy\\n> - item", "| a | b |\\n| --- | --- |\\n| @ | 1 |", "[@]: /link 'title'", "@\\n---", "1) @\\n\\n       code")
_UNITS_SQL = """WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l AS (SELECT doc_id, i, i % 10 AS kind, 'x' || rtrim(left(regexp_replace(raw, '[\\[\\]`|\\t]', '', 'g'), 60)) AS x FROM line),
h AS (SELECT *, count(*) FILTER (WHERE kind IN (0, 8)) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
u AS (SELECT doc_id, section, i, kind IN (2, 3, 9) AS tight, CASE kind WHEN 1 THEN x || chr(10) || '  ' || x WHEN 2 THEN '- ' || x || chr(10) || chr(10) || '  > quoted' || chr(10) || 'lazy' WHEN 3 THEN '- ' || x || chr(10) || '  1. inner' || chr(10) || 'lazy'
  WHEN 4 THEN '```go' || chr(10) || x || chr(10) || '```' || chr(10) || '- none' || chr(10) || '```' WHEN 5 THEN '> ' || x || chr(10) || 'lazy' || chr(10) || '> - item' WHEN 6 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || x || ' | 1 |'
  WHEN 9 THEN '1) ' || x || chr(10) || chr(10) || '       code' END AS t FROM h WHERE kind NOT IN (0, 7, 8)),
named AS (SELECT doc_id, section, CASE kind WHEN 0 THEN 1 ELSE 2 END AS level, CASE kind WHEN 0 THEN x || chr(10) || x ELSE x END AS title FROM h WHERE kind IN (0, 8)),
one AS (SELECT doc_id, section, title AS above FROM named WHERE level = 1)
SELECT u.doc_id, CAST(u.section AS INTEGER) AS section, n.level, n.title, CASE WHEN n.level = 1 THEN n.title ELSE one.above || ' > ' || n.title END AS path, CAST(row_number() OVER (PARTITION BY u.doc_id, u.section ORDER BY i) - 1 AS INTEGER) AS unit, tight, md5(t) AS md5
FROM u JOIN named n USING (doc_id, section) LEFT JOIN one ON one.doc_id = u.doc_id AND one.section = u.section - 1"""


@query(_UNITS_SQL)
def markdown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as headings with underlines, nested lists, lazy lines, fences of four marks, quotes, tables and link definitions: sections and units."""
    line = lambda x: F.concat(F.lit("x"), F.rtrim(F.substring(F.regexp_replace(x, "[\\[\\]`|\\t]", ""), 1, 60)))
    block = lambda i: F.element_at(F.array(*[F.lit(b.replace("\\n", "\n")) for b in _BLOCKS]), (i % 10 + 1).cast("int"))
    source = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.replace(block(i), F.lit("@"), line(x))), "\n\n")
    made = chunking.markdown_sections(table(spark, sf_dir, "documents").select("doc_id", source.alias("text")), "doc_id")
    units = made.select("doc_id", "section", "level", "title", F.array_join("path", " > ").alias("path"), F.posexplode("units").alias("unit", "u"))
    return units.select("doc_id", "section", "level", "title", "path", "unit", F.col("u.tight").alias("tight"), F.md5("u.text").alias("md5"))
