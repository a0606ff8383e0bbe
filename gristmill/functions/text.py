"""Text preparation as Spark expressions: HTML strip, caption cleaning, shell signals, UTF-16 offsets.

Everything stays in the JVM. Offsets that callers see count UTF-16 units; texts without characters beyond the basic
plane, nearly all, take the cheap path on which code points are the same.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, FULL_CHARS = 32_000, 5_000_000
TEXT_NOISE = tuple("script style noscript nav header footer".split())
BLOCK_ENDS = r"(?i)</(?:article|section|h[1-6]|tr|li|div|p)>"
#: Entity pattern and text. `&amp;` comes last: that equals one pass from left to right.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&#xa0;", " "),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"),
    ("&amp;", "&"),
]
SHELL_FLOOR, SHELL_TEXT_RATIO, SHELL_SCRIPT_RATIO = 600, 0.08, 0.45
SHELL, SHELL_WITH_STATE = "js-shell-suspected", "js-shell-suspected-embedded-state-available"
SCRIPT_BLOCK = r"(?is)<script(?:[^a-z0-9_>][^>]*)?(?:>.*?(?:</script>|\z)|\z)"
EMPTY_MOUNT = r"""(?i)<div\b[^>]*?\bid=["'](?:app|root|__next)["'][^>]*?>[\s]*</div>"""
#: White space as scripts in pages trim it: Unicode spaces and the byte-order mark.
SPACES = " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def u16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def basic_plane(c: Column) -> Column:
    """Whether no character of the text is beyond the basic plane."""
    return ~c.rlike(r"[\x{10000}-\x{10FFFF}]")


def u16_slice(c: Column, start: Column, end: Column) -> Column:
    """The text from one UTF-16 offset to another; a character of two units belongs to where its first one is.

    Beyond the basic plane, a noncharacter after each such character makes places of code points those of units.
    """
    wide = F.regexp_replace(c, r"([\x{10000}-\x{10FFFF}])", "$1\uffff")
    cut = F.regexp_replace(F.substring(wide, start + 1, end - start), r"^\x{FFFF}|(?<=[\x{10000}-\x{10FFFF}])\x{FFFF}", "")
    return F.when(basic_plane(c), F.substring(c, start + 1, end - start)).otherwise(cut)


def u16_offset(c: Column, points: Column) -> Column:
    """The UTF-16 offset of a code-point offset."""
    return F.when(basic_plane(c), points.cast("bigint")).otherwise(u16_length(F.substring(c, F.lit(1), points.cast("int"))))


def decode_entities(c: Column) -> Column:
    """Texts without an ampersand, most lines, take no pass at all."""
    return let(c, lambda x: F.when(F.contains(x, F.lit("&")), _decoded(x)).otherwise(x))


def _decoded(c: Column) -> Column:
    for name, text in ENTITIES:
        c = F.regexp_replace(c, f"(?i){re.escape(name)}", text.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def _tags_replaced(c: Column, pattern: str, by: str) -> Column:
    """Every match of a pattern that ends with `>` replaced. Only what is before the last `>` is searched: after it, each `<` would be read to the end in vain."""
    tail = F.substring_index(c, ">", -1)
    return F.concat(F.regexp_replace(F.substring(c, F.lit(1), F.length(c) - F.length(tail)), pattern, by), tail)


def _without_element(c: Column, tag: str) -> Column:
    """Without the element and its content. Linear: lazy matching only runs up to the last closing tag, before which all open ones close."""
    def stripped(head: Column) -> Column:
        return F.concat(F.regexp_replace(head, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " "), F.substring(c, F.length(head) + 1, F.length(c)))

    whole = let(F.regexp_extract(c, rf"(?is)\A.*</{tag}>", 0), stripped)
    return let(whole, lambda x: _tags_replaced(x, rf"(?i)<{tag}\b[^>]*/?>", " "))


def _stripped(c: Column, tag: str) -> Column:
    return let(c, lambda x: F.when(x.rlike(f"(?i)<{tag}"), _without_element(x, tag)).otherwise(x))


def html_to_text(c: Column, max_chars: int = MAX_CHARS) -> Column:
    """Visible text of HTML, a trimmed non-blank line per block."""
    for tag in TEXT_NOISE:
        c = _stripped(c, tag)
    c = F.regexp_replace(F.regexp_replace(c, BLOCK_ENDS, "\n"), r"(?i)<br\s*/?>", "\n")
    c = decode_entities(let(c, lambda x: _tags_replaced(x, r"<[^>]+>", " ")))
    lines = F.transform(F.split(F.regexp_replace(c, r"[ \t]+", " "), "\n", -1), trimmed)
    return F.substring(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 1, max_chars)


def vtt_to_text(c: Column, max_chars: int = MAX_CHARS) -> Column:
    """The spoken lines of a caption track: cue payloads without tags, rolling repeats once.

    Cleaned lines between blank ones are a block; what follows a block's first timing line is payload.
    """
    def cleaned(line: Column) -> Column:
        return trimmed(F.regexp_replace(decode_entities(_tags_replaced(line, r"<[^>]+>", "")), r"[ \t]+", " "))

    lines = F.transform(F.split(c, r"\r?\n", -1), cleaned)
    blocks = F.filter(F.split(F.array_join(lines, "\n"), r"\n{2,}", -1), lambda b: F.contains(b, F.lit("-->")))
    payload = F.flatten(
        F.transform(
            blocks,
            lambda b: F.filter(
                F.split(F.regexp_replace(b, r"(?s)\A(?:(?!-->)[^\n]*?\n)*?[^\n]*-->[^\n]*\n?", ""), "\n", -1),
                lambda x: (x != "") & ~F.contains(x, F.lit("-->")),
            ),
        )
    )
    once = let(payload, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
    return F.substring(F.array_join(once, "\n"), 1, max_chars)


def collapse_markdown(c: Column, max_chars: int = MAX_CHARS) -> Column:
    return F.substring(trimmed(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")), 1, max_chars)


def script_chars(html: Column) -> Column:
    """Characters in script elements; an unclosed one reaches to the end."""
    return F.length(html) - F.length(F.regexp_replace(html, SCRIPT_BLOCK, ""))


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def shell_signals(html: Column, text: Column, has_state: Column) -> Column:
    """Struct (raw_chars, text_chars, text_ratio, script_ratio, empty_mount, suspected, warning) of a page that may need rendering."""
    raw, prepared = F.length(html), F.length(text)
    text_ratio = F.when(raw > 0, prepared / raw).otherwise(F.lit(1.0))
    script_ratio = F.when(raw > 0, script_chars(html) / raw).otherwise(F.lit(0.0))
    mount = html.rlike(EMPTY_MOUNT)
    small = (prepared < SHELL_FLOOR) & (text_ratio < SHELL_TEXT_RATIO)
    suspected = small & ((script_ratio >= SHELL_SCRIPT_RATIO) | mount)
    detail = F.concat(
        F.lit("prepared text "), prepared.cast("string"), F.lit(" chars is "), _percent(text_ratio), F.lit(" of "), raw.cast("string"),
        F.lit("-char HTML; scripts "), _percent(script_ratio), F.lit(" of HTML"),
        F.when(mount, "; client-render mount element is empty").otherwise(""),
    )
    warning = F.when(
        suspected,
        F.when(has_state, F.concat(F.lit(f"{SHELL_WITH_STATE}: "), detail, F.lit("; embedded state was harvested, so this page is extractable WITHOUT a browser render"))).otherwise(
            F.concat(F.lit(f"{SHELL}: "), detail, F.lit("; page likely requires JavaScript rendering upstream before extraction"))
        ),
    )
    return F.struct(
        raw.alias("raw_chars"), prepared.alias("text_chars"), text_ratio.alias("text_ratio"), script_ratio.alias("script_ratio"),
        mount.alias("empty_mount"), suspected.alias("suspected"), warning.alias("warning"),
    )


def is_pure_shell_warning(c: Column) -> Column:
    return F.startswith(c, F.lit(f"{SHELL}:"))


def occurrences(text: Column, excerpt: Column) -> Column:
    """Array of (index, start, end), UTF-16, of all exact matches, overlapping ones too, in order; empty for an empty excerpt."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(excerpt, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(text, quoted, -1)
    starts = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out")
        ),
        lambda s: s["out"],
    )
    starts = F.when(F.startswith(text, excerpt), F.concat(F.array(F.lit(0)), starts)).otherwise(starts)
    size = u16_length(excerpt)

    def spans(plain: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            at = F.when(plain, p.cast("bigint")).otherwise(u16_length(F.substring(text, F.lit(1), p)))
            return F.struct(i.cast("int").alias("index"), at.alias("start"), (at + size).alias("end"))

        return F.transform(starts, one)

    none = F.array().cast("array<struct<index:int,start:bigint,end:bigint>>")
    return F.when((F.length(excerpt) > 0) & F.contains(text, excerpt), let(basic_plane(text), spans)).otherwise(none)


def nth_occurrence(text: Column, excerpt: Column, n: Column) -> Column:
    """The code-point offset of the n-th (from 1) match that doesn't overlap an earlier one; null if there are fewer."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(excerpt, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    before = F.aggregate(F.slice(pieces, 1, n), F.lit(0), lambda s, p: s + F.length(p))
    return F.when((F.length(excerpt) > 0) & (n >= 1) & (n < F.size(pieces)), before + (n - 1) * F.length(excerpt))
