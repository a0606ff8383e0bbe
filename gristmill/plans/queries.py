"""Queries of the extraction operators over whole tables, each with SQL that another engine answers alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.operators import artifacts, chunking, evaluation, grounding, ledger, outcomes, pdf
from gristmill.sources import robots, snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# preparation

_STRIP = "html"
for _tag in T.TEXT_NOISE:
    _STRIP = f"regexp_replace(regexp_replace({_STRIP}, '<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'gis'), '<{_tag}\\b[^>]*/?>', ' ', 'gi')"
_STRIP = f"regexp_replace(regexp_replace({_STRIP}, '</(article|section|h[1-6]|tr|li|div|p)>', chr(10), 'gi'), '<br\\s*/?>', chr(10), 'gi')"
_STRIP = f"regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g')"
for _name, _text in T.ENTITIES:
    _STRIP = f"regexp_replace({_STRIP}, '{_name}', '{_text.replace(chr(39), chr(39) * 2)}', 'gi')"
_STRIP = (
    f"array_to_string(list_filter(list_transform(string_split(regexp_replace({_STRIP}, '[ \\t]+', ' ', 'g'), chr(10)), "
    "lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> ''), chr(10))"
)
_TEXTS = f"SELECT page_id, html, {_STRIP} AS text FROM pages"


@query(f"SELECT page_id, text FROM ({_TEXTS})")
def html_to_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html"), T.FULL_CHARS).alias("text"))


@query(f"""
WITH s AS (SELECT page_id, length(html) AS raw_chars, length(text) AS text_chars, length(text) / length(html)::DOUBLE AS text_ratio,
  (length(html) - length(regexp_replace(html, '<script(?:[^a-z0-9_>][^>]*)?(?:>.*?(?:</script>|\\z)|\\z)', '', 'gis'))) / length(html)::DOUBLE AS script_ratio,
  regexp_matches(html, '<div\\b[^>]*?\\bid=["''](?:app|root|__next)["''][^>]*?>[\\s]*</div>', 'i') AS empty_mount FROM ({_TEXTS})),
w AS (SELECT *, text_chars < 600 AND text_ratio < 0.08 AND (script_ratio >= 0.45 OR empty_mount) AS suspected FROM s)
SELECT page_id, raw_chars, text_chars, round(text_ratio, 9) AS text_ratio, round(script_ratio, 9) AS script_ratio, empty_mount, suspected,
  CASE WHEN suspected THEN 'js-shell-suspected: prepared text ' || text_chars || ' chars is ' || printf('%.1f%%', text_ratio * 100) || ' of ' || raw_chars || '-char HTML; scripts ' || printf('%.1f%%', script_ratio * 100)
    || ' of HTML' || CASE WHEN empty_mount THEN '; client-render mount element is empty' ELSE '' END || '; page likely requires JavaScript rendering upstream before extraction' END AS warning
FROM w""")
def page_shell_signals(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").withColumn("text", T.html_to_text(F.col("html"), T.FULL_CHARS))
    s = pages.select("page_id", T.shell_signals(F.col("html"), F.col("text"), F.lit(False)).alias("s"))
    return s.select(
        "page_id", "s.raw_chars", "s.text_chars", F.round("s.text_ratio", 9).alias("text_ratio"), F.round("s.script_ratio", 9).alias("script_ratio"), "s.empty_mount", "s.suspected", "s.warning"
    )


@query("""
WITH cues AS (
  SELECT conv_id, turn, '00:0' || (turn % 10) || ' --> 00:09' || chr(10) || text || chr(10) || text AS cue FROM conversations
), track AS (
  SELECT conv_id, string_agg(cue, chr(10) || chr(10) ORDER BY turn) AS vtt FROM cues GROUP BY conv_id
), lines AS (
  SELECT conv_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (
    SELECT conv_id, list_transform(regexp_split_to_array(vtt, '\\r?\\n'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g'))) AS l FROM track)
), state AS (
  SELECT *, last_value(CASE WHEN x = '' THEN 0 WHEN contains(x, '-->') THEN 1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS inside FROM lines
), payload AS (
  SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM state WHERE inside = 1 AND x <> '' AND NOT contains(x, '-->')
)
SELECT conv_id, string_agg(x, chr(10) ORDER BY i) AS transcript FROM payload WHERE before IS NULL OR before <> x GROUP BY conv_id""")
def vtt_clean(spark, sf_dir):
    cue = F.concat(F.lit("00:0"), (F.col("turn") % 10).cast("string"), F.lit(" --> 00:09\n"), F.col("text"), F.lit("\n"), F.col("text"))
    tracks = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("x"))
    return tracks.select("conv_id", T.vtt_to_text(F.array_join(F.transform("x", lambda c: c["cue"]), "\n\n"), T.FULL_CHARS).alias("transcript"))


# chunks

_WINDOWS = """
SELECT doc_id, length(text) AS n, i AS chunk_idx, i * {step} AS "start", least(i * {step} + {size}, length(text)) AS "end", substr(text, i * {step} + 1, {size}) AS chunk
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(greatest(length(text) - {size}, 0) / {step}.0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)"""


@query(f"SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, \"start\", \"end\", sha256(chunk) AS digest FROM ({_WINDOWS.format(size=12_000, step=11_800)})")
def window_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.window_chunks(docs, most=None).select("doc_id", "chunk_idx", "start", "end", F.sha2("chunk", 256).alias("digest"))


@query(f"""
SELECT doc_id, CAST(least(count(*), 5) AS INTEGER) AS kept, CAST(greatest(count(*) - 5, 0) AS INTEGER) AS truncated,
  CASE WHEN count(*) > 5 THEN 'max-chunks' END AS reason FROM ({_WINDOWS.format(size=400, step=350)}) GROUP BY doc_id""")
def chunk_cap_partial(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = chunking.window_count(F.col("text"), 400, 50)
    return docs.where(F.length("text") > 0).select(
        "doc_id", F.least(n, F.lit(5)).alias("kept"), F.greatest(n - 5, F.lit(0)).alias("truncated"), F.when(n > 5, "max-chunks").alias("reason")
    )


@query("""
WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:4] AS l FROM documents),
o AS (SELECT doc_id, unnest(range(len(l))) AS chunk_idx, unnest(l) AS x FROM p)
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(coalesce(sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start", length(x) AS size FROM o""")
def assembled_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", chunking.assembled(F.split("text", "\n", -1), 4).alias("a"))
    return docs.select("doc_id", F.posexplode("a.chunks").alias("chunk_idx", "c")).select("doc_id", "chunk_idx", "c.start", (F.col("c.end") - F.col("c.start")).alias("size"))


# grounding

_WORD = "regexp_extract(text, '[A-Za-z]{2,}', 0)"
#: Each document's first word and where it occurs, overlaps included.
_SPOTS = f"""
SELECT doc_id, text, w, list_filter(range(length(text) - length(w) + 1), lambda i: text[i + 1 : i + length(w)] = w) AS spots
FROM (SELECT doc_id, text, {_WORD} AS w FROM documents WHERE {_WORD} <> '')"""


@query(f"""
WITH d AS ({_SPOTS})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS idx, s AS "start", s + length(w) AS "end"
FROM (SELECT doc_id, w, unnest(spots) AS s FROM d)""")
def occurrences(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]{2,}", 0).alias("w"))
    return docs.select("doc_id", F.explode(T.occurrences(F.col("text"), F.col("w"))).alias("o")).select("doc_id", F.col("o.index").alias("idx"), "o.start", "o.end")


_PROPOSED = f"""
SELECT doc_id, k AS seq, CASE k % 4 WHEN 0 THEN 'terms[0].name' WHEN 3 THEN 'unknown' ELSE 'title' END AS path, CASE WHEN k = 5 THEN 'no such excerpt' ELSE w END AS excerpt,
  CASE WHEN k = 2 THEN 1.5 WHEN k = 6 THEN CAST('nan' AS DOUBLE) ELSE 0.5 END AS confidence, text, spots FROM ({_SPOTS}), range(8) AS r(k)"""


def _texts(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("full_text"))


def _proposals(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", "[A-Za-z]{2,}", 0).alias("w")).where("w != ''")
    k = F.col("k")
    return docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        F.col("doc_id").alias("run_id"), k.cast("bigint").alias("seq"),
        F.when(k % 4 == 0, "terms[0].name").when(k % 4 == 3, "unknown").otherwise("title").alias("field_path"), F.lit("v").alias("value_canon"),
        F.when(k == 2, 1.5).when(k == 6, float("nan")).otherwise(0.5).alias("confidence"), F.when(k == 5, "no such excerpt").otherwise(F.col("w")).alias("excerpt"),
        F.lit("scan").alias("extractor"), F.lit(None).cast("int").alias("occurrence_hint"), F.lit(None).cast("bigint").alias("visible_start"), F.lit(None).cast("bigint").alias("visible_end"),
    )


def _schema(spark) -> DataFrame:
    return spark.createDataFrame([("terms[].name", "string", None, None), ("title", "string", None, "explicit")], "path string, type string, enum_values array<string>, inference_type string")


@query(f"""
WITH p AS ({_PROPOSED}), r AS (
  SELECT *, CASE WHEN path = 'unknown' THEN 'unknown-field-path' WHEN NOT contains(text, excerpt) THEN 'excerpt-not-found' END AS gate FROM p
), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path, excerpt, gate IS NULL ORDER BY seq) AS k FROM r)
SELECT doc_id AS run_id, seq, replace(path, '[0]', '[]') AS field_path, CASE WHEN gate IS NOT NULL THEN gate WHEN isnan(confidence) THEN 'non-numeric-confidence' END AS drop_reason,
  CASE WHEN gate IS NULL AND NOT isnan(confidence) THEN least(confidence, 1.0) END AS confidence,
  CASE WHEN gate IS NULL AND NOT isnan(confidence) THEN 'chars:' || spots[least(k, len(spots))] || '-' || (spots[least(k, len(spots))] + length(excerpt)) END AS locator FROM a""")
def ground_proposals(spark, sf_dir):
    return grounding.normalized(_proposals(spark, sf_dir), _texts(spark, sf_dir), _schema(spark), 2).select("run_id", "seq", "field_path", "drop_reason", "confidence", "locator")


@query("""
WITH w AS (SELECT conv_id, turn, role, text[1:1] AS value, length(text) % 7 / 10.0 AS confidence FROM conversations)
SELECT conv_id AS run_id, min(turn) AS position, arg_max(turn, confidence * 1000000 - turn) AS seq, max(confidence) AS confidence, role AS field_path, value AS value_canon, count(*) - 1 AS duplicates
FROM w GROUP BY conv_id, role, value""")
def dedup_proposals(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("field_path"), F.lit(None).cast("array<int>").alias("path_indices"),
        F.substring("text", 1, 1).alias("value_canon"), (F.length("text") % 7 / 10.0).alias("confidence"), F.lit("chars:0-1").alias("locator"),
    )
    return grounding.deduplicated(rows).drop("path_indices", "locator")


@query("""
SELECT doc_id, 'items[].tags[].name' AS path, CAST(doc_id % 5 AS INTEGER) AS first, CAST(quality AS INTEGER) AS second FROM labels""")
def path_normalize(spark, sf_dir):
    raw = F.concat(F.lit("items["), (F.col("doc_id") % 5).cast("string"), F.lit("].tags["), F.col("quality").cast("string"), F.lit("].name"))
    rows = _table(spark, sf_dir, "labels").select("doc_id", grounding.indexed_path(raw).alias("p"))
    return rows.select("doc_id", "p.path", F.get("p.indices", F.lit(0)).alias("first"), F.get("p.indices", F.lit(1)).alias("second"))


# dispatch and classes


@query("""
WITH c AS (SELECT conv_id, turn, length(text) AS tokens, row_number() OVER w AS k, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT conv_id, sum(CASE WHEN k <= 4 AND before < 900 THEN 1 ELSE 0 END) AS completed, count(*) AS n, sum(CASE WHEN k <= 4 AND before < 900 THEN tokens ELSE 0 END) AS used FROM c GROUP BY conv_id)
SELECT conv_id AS run_id, completed::BIGINT AS completed, (n - completed)::BIGINT AS remaining, used::BIGINT AS tokens_used, CASE WHEN n = completed THEN NULL WHEN completed >= 4 THEN 'max-provider-calls' ELSE 'max-total-tokens' END AS reason,
  CASE WHEN n > completed AND used > 900 THEN (used - 900)::BIGINT ELSE 0 END AS token_overshoot FROM a""")
def budget_stop(spark, sf_dir):
    calls = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("chunk_idx"), F.length("text").alias("tokens"))
    return outcomes.budget_stops(calls, 4, 900).fillna(0, ["token_overshoot"])


@query("""
WITH e AS (SELECT event_id, CAST(400 + event_id % 110 AS INTEGER) AS status, CASE event_id % 7 WHEN 0 THEN 'auth_failed' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'invalid_request' ELSE '' END AS code, CASE WHEN event_id % 11 = 0 THEN 'Timeout while reading' ELSE '' END AS message FROM events),
k AS (SELECT *, CASE WHEN status IN (401, 403) OR contains(code, 'auth') THEN 'authentication' WHEN status = 429 OR contains(code, 'rate') THEN 'rate-limit' WHEN message <> '' OR status = 408 THEN 'timeout'
  WHEN status BETWEEN 400 AND 499 OR contains(code, 'invalid_request') THEN 'invalid-request' WHEN status >= 500 THEN 'unavailable' ELSE 'unknown' END AS kind FROM e)
SELECT event_id, kind, kind IN ('rate-limit', 'timeout', 'unavailable') AS retryable, status = 429 OR status BETWEEN 500 AND 599 AS retry_fetch FROM k""")
def provider_failure_class(spark, sf_dir):
    n = F.col("event_id")
    e = _table(spark, sf_dir, "events").select(
        n, (400 + n % 110).cast("int").alias("status"), F.when(n % 7 == 0, "auth_failed").when(n % 7 == 1, "rate_limit").when(n % 7 == 2, "invalid_request").otherwise("").alias("code"),
        F.when(n % 11 == 0, "Timeout while reading").otherwise("").alias("message"),
    ).withColumn("kind", outcomes.failure_kind(F.col("status"), F.col("code"), F.col("message")))
    return e.select("event_id", "kind", outcomes.retryable(F.col("kind"), F.lit(None).cast("boolean")).alias("retryable"), U.is_retryable(F.col("status")).alias("retry_fetch"))


_MESSAGES = [
    "stopped after 3 provider call(s): cancelled; 2 chunk(s) not processed", "prepared artifact storage failed: disk", "chunk 1/2 provider call failed: x", "dropped a proposal that was not an object",
    "dropped 2 chunk(s) beyond maxChunks; content truncated", "chunked into 3 chunks by character window", "js-shell-suspected: prepared text 3 chars", "retry 1/2",
]


@query("""
WITH e AS (SELECT event_id, ['%s'][1 + event_id %% 8] AS w FROM events)
SELECT event_id, CASE WHEN regexp_matches(w, '^stopped after ') THEN 'partial-stop' WHEN regexp_matches(w, '^prepared artifact storage failed') THEN 'prepared-artifact-storage-failed'
  WHEN regexp_matches(w, 'provider call failed|^response truncated|^provider returned') THEN 'provider-warning' WHEN regexp_matches(w, '^dropped .*proposal|^clamped |normalization failed') THEN 'proposal-normalization'
  WHEN contains(w, 'beyond maxChunks') THEN 'content-truncated' WHEN contains(w, 'chunked into') THEN 'content-chunking' WHEN contains(w, 'js-shell') THEN 'content-preparation-warning' ELSE 'unclassified-warning' END AS code,
  CASE event_id %% 8 WHEN 3 THEN 'provider-or-runtime-warning' WHEN 5 THEN 'chunked-input' ELSE 'provider-or-runtime-warning' END AS failure FROM e""" % "', '".join(_MESSAGES))
def outcome_warning_class(spark, sf_dir):
    w = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 8).cast("int"))
    e = _table(spark, sf_dir, "events").select("event_id", w.alias("w"))
    return e.select("event_id", outcomes.warning_class(F.col("w"))["code"].alias("code"), evaluation.failure_code(F.col("w")).alias("failure"))


# identity

_IDENTITY = """
SELECT doc_id, sha256(text) AS digest, 'prepared-artifact:v1:sha256:' || sha256('{"format":"prepared-artifact","version":1,"digest":"' || sha256(text) || '","preparationMode":"' || 'text' || '","preparationVersion":"' || '1' || '","contentLength":' || length(text) || ',"sourceSnapshotRef":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"snapshot:' || source || '"' END || '}') AS ref FROM documents"""


def _artifacts(spark, sf_dir) -> DataFrame:
    ref = F.when(F.col("doc_id") % 2 != 0, F.concat(F.lit("snapshot:"), F.col("source")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", ref.alias("snap"))
    return docs.select("doc_id", "text", artifacts.artifact(F.col("text"), F.lit("text"), F.col("snap")).alias("artifact"))


@query(_IDENTITY)
def artifact_identity(spark, sf_dir):
    return _artifacts(spark, sf_dir).select("doc_id", "artifact.digest", "artifact.ref")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'digest-mismatch' ELSE 'identity-mismatch' END AS state FROM documents")
def artifact_resolve(spark, sf_dir):
    return _resolve_own(_artifacts(spark, sf_dir))


def _resolve_own(a: DataFrame) -> DataFrame:
    n = F.col("doc_id") % 4
    own = a.select("doc_id", artifacts.artifact(F.concat(F.col("doc_id").cast("string"), F.col("text")), F.lit("text"), F.lit(None).cast("string")).alias("artifact"), F.concat(F.col("doc_id").cast("string"), F.col("text")).alias("t"))
    texts = own.where(n != 1).select(F.col("artifact.ref").alias("ref"), F.when(n == 2, F.concat("t", F.lit("!"))).otherwise(F.col("t")).alias("text"))
    asked = own.select("doc_id", F.when(n == 3, F.col("artifact").withField("content_length", F.col("artifact.content_length") + 1)).otherwise(F.col("artifact")).alias("artifact"))
    return artifacts.resolved(asked, texts).select("doc_id", "state")


# snapshots, robots, references

_SNAPSHOTS = "SELECT 'user' || (event_id % 50) AS source_id, 'https://h.example/' || user_id AS url, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS fetched_at, sha256(event_id || props) AS body_hash, event_id FROM events"


def _snapshots(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), (F.col("event_id") % 50).cast("string")).alias("source_id"), F.concat(F.lit("https://h.example/"), F.col("user_id").cast("string")).alias("url"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"), F.sha2(F.concat(F.col("event_id").cast("string"), "props"), 256).alias("body_hash"), "event_id",
    )


@query(f"SELECT source_id, url, fetched_at, body_hash, event_id FROM ({_SNAPSHOTS}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, body_hash DESC) = 1")
def snapshot_latest(spark, sf_dir):
    return snapshots.latest(_snapshots(spark, sf_dir))


@query(f"""
WITH s AS ({_SNAPSHOTS}), w AS (SELECT DISTINCT source_id, chr(CAST(97 + CAST(replace(source_id, 'user', '') AS INTEGER) % 6 AS INTEGER)) AS prefix FROM s)
SELECT s.source_id, prefix, body_hash FROM s JOIN w ON s.source_id = w.source_id AND starts_with(body_hash, prefix)
QUALIFY row_number() OVER (PARTITION BY s.source_id, prefix ORDER BY fetched_at DESC, body_hash DESC) = 1""")
def snapshot_get_prefix(spark, sf_dir):
    s = _snapshots(spark, sf_dir)
    wanted = s.select("source_id", F.char(97 + F.replace("source_id", F.lit("user"), F.lit("")).cast("int") % 6).alias("prefix")).distinct()
    return snapshots.by_prefix(s, wanted).select("source_id", "prefix", "body_hash")


@query(f"""
WITH l AS (SELECT *, 'W/' || substr(body_hash, 1, 6) AS etag FROM ({_SNAPSHOTS}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, body_hash DESC) = 1),
r AS (SELECT event_id, 'user' || (event_id % 60) AS source_id, 'https://h.example/' || user_id || CASE WHEN event_id % 3 = 0 THEN '#top' ELSE '' END AS url FROM events)
SELECT r.event_id, CASE WHEN regexp_replace(r.url, '#.*$', '') = l.url THEN etag END AS if_none_match FROM r LEFT JOIN l ON r.source_id = l.source_id""")
def conditional_get(spark, sf_dir):
    s = _snapshots(spark, sf_dir).withColumn("etag", F.concat(F.lit("W/"), F.substring("body_hash", 1, 6))).withColumn("last_modified", F.lit(None).cast("string")).drop("event_id")
    asked = _table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("user"), (F.col("event_id") % 60).cast("string")).alias("source_id"), F.lit(True).alias("revalidate"),
        F.concat(F.lit("https://h.example/"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "#top").otherwise("")).alias("url"),
    )
    return snapshots.conditional(asked, s).select("event_id", "if_none_match")


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: grist\nUser-agent: mill\nDisallow: /a\nAllow: /ab\nDisallow: /p # note\nDisallow:\nAllow: /page\n\nUser-agent: *\nDisallow: /\n"


@query("""
WITH p AS (SELECT page_id, CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END AS path FROM (SELECT page_id, regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS r FROM pages)),
rules(rule, allow) AS (VALUES ('/a', false), ('/ab', true), ('/p', false), ('/page', true))
SELECT page_id, path, coalesce(arg_max(allow, length(rule) * 2 + allow::INT), true) AS allowed FROM p LEFT JOIN rules ON starts_with(path, rule) GROUP BY page_id, path""")
def robots_allowed(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", U.path_and_query(F.col("url")).alias("path"), F.lit("o").alias("origin"))
    files = spark.createDataFrame([("o", _ROBOTS, "Mill/1.0 (test)")], "origin string, body string, agent string")
    return robots.decided(pages, robots.parsed(files), "page_id").select("page_id", "path", "allowed")


@query("""
SELECT page_id, 'snapshot:' || 'page%20' || page_id || '?url=' || replace(replace(url_encode(url), '%20', '+'), '~', '%7E') || '&sha256=' || sha256(html) || '&fetchedAt=2026-01-01T00%3A00%3A00Z' AS ref, url, 'page ' || page_id AS source_id, true AS same FROM pages""")
def snapshot_ref_roundtrip(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("source_id"), "url", F.sha2("html", 256).alias("body_hash"), F.lit("2026-01-01T00:00:00Z").alias("fetched_at")
    )
    rows = snapshots.with_refs(pages).withColumn("p", U.parsed_ref(F.col("snapshot_ref"), ("snapshot", "capture")))
    other = U.parsed_ref(U.snapshot_ref(F.col("source_id"), F.col("url"), F.col("body_hash"), F.col("fetched_at"), "capture"), ("snapshot", "capture"))
    return rows.select("page_id", F.col("snapshot_ref").alias("ref"), "p.url", "p.source_id", U.same_ref(F.col("p"), other).alias("same"))


@query("""
WITH v AS (SELECT event_id, 'abcDEF' || event_id AS id, event_id % 6 AS k FROM events)
SELECT event_id, CASE WHEN k = 5 THEN NULL ELSE id END AS video_id, CASE k WHEN 0 THEN 90 WHEN 1 THEN 3723 WHEN 3 THEN 5 ELSE -1 END::BIGINT AS start_seconds FROM v""")
def video_urls(spark, sf_dir):
    v = F.concat(F.lit("abcDEF"), F.col("event_id").cast("string"))
    k = F.col("event_id") % 6
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), v, F.lit("&t=90s"))).when(k == 1, F.concat(F.lit("https://youtu.be/"), v, F.lit("?t=1h2m3s")))
        .when(k == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), v)).when(k == 3, F.concat(F.lit("https://youtube.com/embed/"), v, F.lit("?start=5")))
        .when(k == 4, F.concat(F.lit("https://youtube.com/live/"), v)).otherwise(F.concat(F.lit("https://video.example/watch?v="), v))
    )
    rows = _table(spark, sf_dir, "events").select("event_id", U.video_url(url).alias("p"))
    return rows.select("event_id", "p.video_id", F.coalesce("p.start_seconds", F.lit(-1)).alias("start_seconds"))


@query("""
WITH t AS (SELECT event_id % 200 AS video, event_id, CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'en-orig' ELSE 'en' END AS lang FROM events WHERE event_type <> 'click')
SELECT video, lang, event_id AS track FROM t QUALIFY row_number() OVER (PARTITION BY video ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN lang = 'en-orig' THEN 1 WHEN lang LIKE 'en%' THEN 2 ELSE 3 END, event_id) = 1""")
def caption_pick(spark, sf_dir):
    from gristmill.sources.captions import picked

    k = F.col("event_id") % 4
    tracks = _table(spark, sf_dir, "events").where("event_type != 'click'").select(
        (F.col("event_id") % 200).alias("video"), F.col("event_id").alias("track"), F.when(k == 0, "de").when(k == 1, "en-GB").when(k == 2, "en-orig").otherwise("en").alias("lang")
    )
    return picked(tracks, "video", "track")


# layout


@query("""
SELECT doc_id, k * 777 AS "offset", CASE WHEN k * 777 > length(text) + 5000 THEN NULL ELSE CAST(least(floor(k * 777 / 1000) + 1, floor(length(text) / 1000) + 1) AS INTEGER) END AS page
FROM documents, range(6) AS r(k) WHERE k * 777 <= length(text) + 5000""")
def pdf_page_resolve(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 1000).cast("int")), lambda i: (i * 1000).cast("bigint")).alias("pages"))
    rows = docs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")))).where("k * 777 <= n + 5000")
    return rows.select("doc_id", (F.col("k") * 777).alias("offset"), pdf.page_of(F.col("pages"), F.col("k") * 777).alias("page"))


@query("""
WITH e AS (SELECT doc_id, unnest(range(n_chars // 500 + 1)) AS k, n_chars FROM documents), el AS (SELECT doc_id, k AS element_id, k * 500 AS s, k * 500 + 450 AS e FROM e),
sp AS (SELECT doc_id, unnest(range(n_chars // 3000 + 1)) AS span_id FROM documents), s AS (SELECT doc_id, span_id, span_id * 3000 + 440 AS s, span_id * 3000 + 460 + 900 * (span_id % 2) AS e FROM sp)
SELECT s.doc_id, span_id, 'chars:' || s.s || '-' || s.e AS locator, CASE WHEN count(element_id) > 0 THEN 'matched' ELSE 'not-found' END AS status, count(element_id) AS touched, min(element_id) AS first
FROM s LEFT JOIN el ON s.doc_id = el.doc_id AND s.s < el.e AND el.s < s.e GROUP BY s.doc_id, span_id, s.s, s.e""")
def pdf_span_overlap(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    zero = F.lit(0).cast("bigint")
    el = docs.select("doc_id", F.explode(F.sequence(zero, F.floor(F.col("n_chars") / 500))).alias("element_id")).select("doc_id", "element_id", (F.col("element_id") * 500).alias("start"), (F.col("element_id") * 500 + 450).alias("end"))
    s, k = docs.select("doc_id", F.explode(F.sequence(zero, F.floor(F.col("n_chars") / 3000))).alias("span_id")), F.col("span_id")
    locator = F.concat(F.lit("chars:"), (k * 3000 + 440).cast("string"), F.lit("-"), (k * 3000 + 460 + 900 * (k % 2)).cast("string"))
    out = pdf.resolved_spans(s.withColumn("locator", locator), el)
    return out.select("doc_id", "span_id", "locator", "status", F.coalesce(F.size("elements"), F.lit(0)).alias("touched"), F.array_min("elements").alias("first")).withColumn("touched", F.greatest("touched", F.lit(0)).cast("bigint"))


# evaluation and ledger

_CASES = """
WITH p AS (SELECT conv_id AS case_id, turn, role AS field_path, text[1:1] AS value_canon, 'chars:' || (length(text) % 5) || '-9' AS locator FROM conversations),
f AS (SELECT * FROM p WHERE turn % 3 <> 0), g AS (SELECT case_id, turn, field_path, value_canon, CASE WHEN turn % 5 = 1 THEN 'chars:0-1' ELSE locator END AS locator FROM p WHERE turn % 4 <> 0)"""


@query(f"""{_CASES},
c AS (SELECT case_id, count(*) AS offered FROM p GROUP BY 1), n AS (SELECT case_id, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT case_id, sum(a) AS sf, sum(b) AS sw, sum(a * b) AS sb FROM (SELECT case_id, field_path, value_canon, locator, max(a) AS a, max(b) AS b FROM (SELECT case_id, field_path, value_canon, locator, 1 AS a, 0 AS b FROM f UNION ALL SELECT case_id, field_path, value_canon, locator, 0, 1 FROM g) GROUP BY ALL) GROUP BY 1),
v AS (SELECT case_id, sum(b) AS vw, sum(a * b) AS vb FROM (SELECT case_id, field_path, value_canon, max(a) AS a, max(b) AS b FROM (SELECT case_id, field_path, value_canon, 1 AS a, 0 AS b FROM f UNION ALL SELECT case_id, field_path, value_canon, 0, 1 FROM g) GROUP BY ALL) GROUP BY 1),
t AS (SELECT case_id, sum(b) AS tw, sum(a * b) AS tb FROM (SELECT case_id, field_path, max(a) AS a, max(b) AS b FROM (SELECT case_id, field_path, 1 AS a, 0 AS b FROM f UNION ALL SELECT case_id, field_path, 0, 1 FROM g) GROUP BY ALL) GROUP BY 1)
SELECT c.case_id, CASE WHEN coalesce(sf, 0) = 0 THEN CASE WHEN coalesce(sw, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE sb / CAST(sf AS DOUBLE) END AS "precision", CASE WHEN coalesce(sw, 0) = 0 THEN 1.0 ELSE sb / CAST(sw AS DOUBLE) END AS recall,
  CASE WHEN coalesce(vw, 0) = 0 THEN 1.0 ELSE vb / CAST(vw AS DOUBLE) END AS value_accuracy, greatest(0.0, (offered - coalesce(n, 0)) / CAST(offered AS DOUBLE)) AS grounded_drop_rate, CASE WHEN coalesce(tw, 0) = 0 THEN 1.0 ELSE tb / CAST(tw AS DOUBLE) END AS schema_coverage
FROM c LEFT JOIN n USING (case_id) LEFT JOIN s USING (case_id) LEFT JOIN v USING (case_id) LEFT JOIN t USING (case_id)""")
def eval_metrics(spark, sf_dir):
    p = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), "turn", F.col("role").alias("field_path"), F.substring("text", 1, 1).alias("value_canon"),
        F.concat(F.lit("chars:"), (F.length("text") % 5).cast("string"), F.lit("-9")).alias("locator"),
    )
    gold = p.where("turn % 4 != 0").withColumn("locator", F.when(F.col("turn") % 5 == 1, "chars:0-1").otherwise(F.col("locator")))
    return evaluation.case_metrics(p.groupBy("case_id").agg(F.count(F.lit(1)).alias("offered")), p.where("turn % 3 != 0"), gold)


@query("""
SELECT conv_id, role, length(text) % 7 AS value, turn % 2 AS pass, turn AS seq FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role, length(text) % 7 ORDER BY turn % 2, turn) = 1""")
def multipass_merge(spark, sf_dir):
    p = _table(spark, sf_dir, "conversations").select("conv_id", "role", (F.length("text") % 7).alias("value"), (F.col("turn") % 2).alias("pass"), F.col("turn").alias("seq"))
    return evaluation.merged_passes(p, ("conv_id", "role", "value"))


def ledger_events(spark, sf_dir) -> DataFrame:
    """Events in pairs: an even one starts a reservation, the odd one after it settles it, or nothing does."""
    n = F.col("event_id")
    kind = F.when(n % 2 == 0, "started").when(n % 10 == 1, "failed").when(n % 10 == 3, "aborted").when(n % 10 == 5, "locally-rejected").otherwise("completed")
    amount = F.struct((n % 100).alias("input_tokens"), (n % 37).alias("output_tokens"), ((n % 8) / 8).alias("spend_usd"))
    return _table(spark, sf_dir, "events").where("event_id % 14 != 13").select(
        kind.alias("event"), (F.floor(n / 2) % 9).cast("string").alias("authorization_digest"), F.floor(n / 2).cast("string").alias("reservation_id"), F.col("ts").alias("recorded_at"),
        F.when(n % 2 == 0, amount).alias("reserved"), F.when(n % 2 == 1, amount).alias("usage"),
    )


_LEDGER = """
WITH e AS (SELECT event_id, event_id // 2 AS r, event_id % 2 AS k, event_id % 100 AS i, event_id % 37 AS o, (event_id % 8) / 8.0 AS u FROM events WHERE event_id % 14 <> 13),
j AS (SELECT s.r % 9 AS a, CASE WHEN t.r IS NULL THEN 'started' WHEN t.event_id % 10 = 1 THEN 'failed' WHEN t.event_id % 10 = 3 THEN 'aborted' WHEN t.event_id % 10 = 5 THEN 'locally-rejected' ELSE 'completed' END AS state,
  s.i, s.o, s.u, t.i AS ti, t.o AS tt, t.u AS tu FROM e s LEFT JOIN e t ON s.r = t.r AND t.k = 1 WHERE s.k = 0),
c AS (SELECT a, state, CASE state WHEN 'started' THEN i WHEN 'locally-rejected' THEN 0 WHEN 'completed' THEN ti ELSE greatest(i, ti) END AS i, CASE state WHEN 'started' THEN o WHEN 'locally-rejected' THEN 0 WHEN 'completed' THEN tt ELSE greatest(o, tt) END AS o,
  CASE state WHEN 'started' THEN u WHEN 'locally-rejected' THEN 0 WHEN 'completed' THEN tu ELSE greatest(u, tu) END AS u FROM j)
SELECT CAST(a AS VARCHAR) AS authorization_digest, CAST(count(*) FILTER (state <> 'locally-rejected') AS BIGINT) AS provider_calls, CAST(sum(i) + sum(o) AS BIGINT) AS total_tokens, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, sum(u)::DOUBLE AS spend_usd,
  count(*) FILTER (state = 'started') AS started, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'aborted') AS aborted, count(*) FILTER (state = 'locally-rejected') AS locally_rejected
FROM c GROUP BY a"""


@query(_LEDGER)
def ledger_totals(spark, sf_dir):
    return ledger.totals(ledger_events(spark, sf_dir))


# pages: trees, which SQL has no parser for


@query()
def html_to_markdown(spark, sf_dir):
    from gristmill.functions import markup

    return _table(spark, sf_dir, "pages").select("page_id", markup.markdown(F.col("html")).alias("markdown"))


@query()
def card_chunks(spark, sf_dir):
    from gristmill.functions import markup

    rows = _table(spark, sf_dir, "pages").select("page_id", markup.cards(F.col("html"), 400, most=None).alias("c"))
    return rows.select("page_id", "c.card_count", "c.structural", F.size("c.chunks").alias("n_chunks"), F.length("c.full_text").alias("length"))


@query("""
WITH e AS (SELECT page_id AS page, k AS pos, (page_id * 2 + k) % n AS link FROM pages, range(3) AS r(k), (SELECT count(*) AS n FROM pages)),
l0 AS (SELECT 's' AS seed_id, 0::BIGINT AS seq, 0 AS depth, 0::BIGINT AS url),
f1 AS (SELECT link AS url, min(seq * 10 + pos) AS spot FROM l0 JOIN e ON url = page GROUP BY link), l1 AS (SELECT 1 + row_number() OVER (ORDER BY spot) - 1 AS seq, 1 AS depth, url FROM f1 WHERE url NOT IN (SELECT url FROM l0)),
k1 AS (SELECT seq, depth, url FROM l0 UNION ALL SELECT seq, depth, url FROM l1),
f2 AS (SELECT link AS url, min(seq * 10 + pos) AS spot FROM l1 JOIN e ON url = page GROUP BY link), l2 AS (SELECT (SELECT max(seq) FROM k1) + row_number() OVER (ORDER BY spot) AS seq, 2 AS depth, url FROM f2 WHERE url NOT IN (SELECT url FROM k1)),
k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM l2),
f3 AS (SELECT link AS url, min(seq * 10 + pos) AS spot FROM l2 JOIN e ON url = page GROUP BY link), l3 AS (SELECT (SELECT max(seq) FROM k2) + row_number() OVER (ORDER BY spot) AS seq, 3 AS depth, url FROM f3 WHERE url NOT IN (SELECT url FROM k2))
SELECT 's' AS seed_id, seq::BIGINT AS seq, depth, url FROM (SELECT * FROM k2 UNION ALL SELECT * FROM l3) WHERE seq < 12""")
def crawl_bfs(spark, sf_dir):
    from gristmill.sources.crawling import breadth_first

    pages = _table(spark, sf_dir, "pages").select("page_id")
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    edges = pages.crossJoin(n).withColumn("pos", F.explode(F.array(*map(F.lit, range(3))))).select(F.col("page_id").alias("page"), "pos", ((F.col("page_id") * 2 + F.col("pos")) % F.col("n")).alias("link"))
    seeds = spark.createDataFrame([("s", 0)], "seed_id string, url bigint")
    return breadth_first(seeds, edges, 12, 3)


@query()
def grounded_extraction(spark, sf_dir):
    """Pages, from HTML to kept proposals: a pattern provider on the whole of every chunk, without a budget of calls."""
    from gristmill.operators.dispatch import Options
    from gristmill.plans.extraction import SCHEMA, extract
    from gristmill.providers import PatternScan

    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("run_id"), F.col("url").alias("source_ref"), F.col("html").alias("content"), F.lit("html").alias("content_type"))
    schema = spark.createDataFrame([("term", "string", None, None, True, "explicit")], SCHEMA)
    run = extract(pages, schema, PatternScan("term", r"\b[A-Z][a-z]{5,}\b"), Options(call_chars=2**30), size=1500, overlap=150, most=None)
    return run.kept.select("run_id", "position", "field_path", "value_json", "locator", "confidence", "duplicates")
