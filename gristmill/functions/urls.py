"""URLs, references and HTTP facts as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "snapshot"
HASH = r"[0-9a-f]{64}"


def form_encode(c: Column) -> Column:
    return F.url_encode(c)


def component_encode(c: Column) -> Column:
    """As in a path part: a space is %20, and ! ' ( ) ~ stay."""
    c = F.regexp_replace(F.url_encode(c), r"\+", "%20")
    for code, text in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(text))
    return c


def snapshot_ref(source_id: Column, url: Column, body_hash: Column, fetched_at: Column, scheme: str = SCHEME) -> Column:
    return F.concat(
        F.lit(f"{scheme}:"), component_encode(source_id), F.lit("?url="), form_encode(url), F.lit("&sha256="), form_encode(body_hash),
        F.lit("&fetchedAt="), form_encode(fetched_at),
    )


def parsed_ref(ref: Column, schemes: tuple[str, ...] = (SCHEME,)) -> Column:
    """Struct (source_id, url, body_hash, fetched_at) of a reference, or null if a part is missing."""
    def part(name: str) -> Column:
        return F.nullif(F.try_url_decode(F.regexp_extract(ref, rf"[?&]{name}=([^&]*)", 1)), F.lit(""))

    head = "|".join(schemes)
    source = F.nullif(F.try_url_decode(F.replace(F.regexp_extract(ref, rf"^(?:{head}):([^?]+)\?", 1), F.lit("+"), F.lit("%2B"))), F.lit(""))
    parts = [source.alias("source_id"), part("url").alias("url"), part("(?:sha256|snapshotSha256)").alias("body_hash"), part("fetchedAt").alias("fetched_at")]
    whole = F.struct(*parts)
    return F.when(whole["source_id"].isNotNull() & whole["url"].isNotNull() & whole["body_hash"].isNotNull() & whole["fetched_at"].isNotNull(), whole)


def same_ref(a: Column, b: Column) -> Column:
    """Whether two parsed references mean the same snapshot, whatever their scheme."""
    return F.coalesce(a == b, F.lit(False))


def resource(url: Column) -> Column:
    """A URL without its fragment, or null if it has no scheme."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_replace(url, "#.*$", ""))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def path_and_query(url: Column) -> Column:
    rest = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    return F.when(rest.rlike("^/"), rest).otherwise(F.concat(F.lit("/"), rest))


def product_token(agent: Column) -> Column:
    return F.lower(F.get(F.split(F.trim(agent), r"[\s/]+"), F.lit(0)))


def content_type(header: Column, hint: Column) -> Column:
    h = F.lower(F.coalesce(header, F.lit("")))
    guess = F.when(h.contains("html"), "html").when(h.contains("pdf"), "pdf").when(h.contains("image/png"), "png")
    return F.coalesce(hint, guess.when(h.rlike("image/jpe?g"), "jpeg").otherwise("text"))


def is_binary(kind: Column) -> Column:
    return kind.isin("pdf", "png", "jpeg")


def is_retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def backoff_ms(attempt: Column, draw: Column, base: int = 250) -> Column:
    """Full-jitter exponential wait before a retry; `draw` is uniform in [0, 1)."""
    return F.floor(draw * base * F.pow(F.lit(2.0), attempt))


def without_conditional(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin("if-none-match", "if-modified-since"))


def source_directory(source_id: Column) -> Column:
    safe = F.substring(F.regexp_replace(source_id, r"[^A-Za-z0-9._-]", "_"), 1, 80)
    return F.concat(safe, F.lit("-"), F.substring(F.sha2(source_id, 256), 1, 8))


def snapshot_file(fetched_at: Column, body_hash: Column) -> Column:
    return F.concat(F.replace(fetched_at, F.lit(":"), F.lit("-")), F.lit("-"), F.substring(body_hash, 1, 12))


def render_policy(policy: Column, legacy: Column) -> Column:
    """Struct (policy, error): `policy` never/always/on-shell-warning, `legacy` a deprecated flag that must not contradict it."""
    old = F.when(legacy, "always").when(~legacy, "never")
    error = F.when(~policy.isin("never", "always", "on-shell-warning"), F.concat(F.lit("unsupported renderPolicy: "), policy)).when(
        policy.isNotNull() & old.isNotNull() & (policy != old), F.concat(F.lit("render ("), legacy.cast("string"), F.lit(") conflicts with renderPolicy ("), policy, F.lit(")"))
    )
    return F.struct(F.when(error.isNull(), F.coalesce(policy, old, F.lit("never"))).alias("policy"), error.alias("error"))


def timestamp_seconds(c: Column) -> Column:
    """`90`, `90s`, `1h2m3s` in seconds; null otherwise."""
    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(c, rf"(\d+){unit}", 1).try_cast("bigint"), F.lit(0).cast("bigint"))

    plain = c.rlike(r"^\d+s?$")
    parts = c.rlike(r"^(?:\d+h)?(?:\d+m)?(?:\d+s)?$") & (c != "")
    return F.when(plain, F.regexp_extract(c, r"^(\d+)", 1).try_cast("bigint")).when(parts, part("h") * 3600 + part("m") * 60 + part("s"))


def video_url(url: Column) -> Column:
    """Struct (video_id, start_seconds) of a video page's URL on the known hosts, or null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), r"^(?:www|m)\.", "")
    rest = F.regexp_extract(url, r"^https?://[^/?#]+(.*)$", 1)
    pick = r"([A-Za-z0-9_-]{6,20})(?=$|[?&#/])"
    found = F.when(host == "youtu.be", F.regexp_extract(rest, rf"^/{pick}", 1)).when(
        host.isin("youtube.com", "music.youtube.com"),
        F.when(rest.rlike(r"^/watch(?:\?|$)"), F.regexp_extract(rest, rf"[?&]v={pick}", 1)).otherwise(
            F.regexp_extract(rest, rf"^/(?:shorts|embed|live|v)/{pick}", 1)
        ),
    )
    at = F.coalesce(F.nullif(F.regexp_extract(rest, r"[?&]t=([^&#]*)", 1), F.lit("")), F.nullif(F.regexp_extract(rest, r"[?&]start=([^&#]*)", 1), F.lit("")))
    return F.when(F.length(found) > 0, F.struct(found.alias("video_id"), timestamp_seconds(at).alias("start_seconds")))


#: Names of parameters that hold credentials: the whole name, or a part of it between hyphens and underscores.
CREDENTIAL_KEY = r"(?i)(?:^|[-_])(?:token|secret|password|passwd|api[-_]?key|authorization|signature|credential)(?:$|[-_])"
AUTHORIZATION = r"(?i)authorization\s*[:=]|bearer\s+[a-z0-9._~-]+"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def references_authorization(ref: str, depth: int = 0) -> bool:
    """Whether a reference carries authorization: an authorization or bearer text, user information, a parameter with the name of a credential, or one whose value is such a reference;
    values are URLs up to two deep, and deeper ones count as carrying it."""
    import re
    from urllib.parse import parse_qsl, urlsplit

    if depth > 2 or re.search(AUTHORIZATION, ref):
        return True
    if not re.match(_URL, ref):
        return False
    try:
        u = urlsplit(ref)
        if u.username or u.password:
            return True
    except ValueError:
        return False
    return any(re.search(CREDENTIAL_KEY, k) or references_authorization(v, depth + 1) for k, v in parse_qsl(u.query, keep_blank_values=True))


def holds_credentials(ref: Column) -> Column:
    """`references_authorization` as an expression, its recursion unrolled."""

    def decoded(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(c), c)

    def carries(c: Column, depth: int) -> Column:
        if depth > 2:
            return F.lit(True)
        query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
        pairs = F.filter(F.split(query, "&"), lambda p: p != "")
        bad = F.exists(
            pairs,
            lambda p: decoded(F.substring_index(p, "=", 1)).rlike(CREDENTIAL_KEY)
            | carries(F.when(F.contains(p, F.lit("=")), decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)))).otherwise(""), depth + 1),
        )
        return c.rlike(AUTHORIZATION) | (c.rlike(_URL) & (c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]+@") | bad))

    return carries(ref, 0)
