"""HTML trees: Markdown, repeated cards, embedded state and links, in one pass over a column of pages.

Spark has no HTML parser, so these are Arrow UDFs over the standard library's. Parsing never fails on any input: unclosed and
crossed elements are closed where a browser would give up on them, and depth is bounded by an explicit stack, not recursion.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column

from .batches import sliced

NOISE = frozenset("script style noscript nav header footer aside form iframe svg template head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr"}
LEAST_CARDS, SIZE, MOST = 3, 12_000, 40
JSONLD_BLOCKS, RAW_CHARS, JSONLD_CHARS, STATE_CHARS = 25, 256_000, 256_000, 512_000


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        """All elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def text(self) -> str:
        out, stack = [], list(self.children[::-1])
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += x.children[::-1]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head") and any(n.tag == tag for n in self.root.walk()):
            return
        if tag in CLOSES_P:
            self._close("p", until=("td", "th", "li", "div", "article", "section", "body"))
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._close(tag, until=("ul", "ol", "table", "dl", "select"))
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, tag, until=()):
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in until:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def pruned(root: Node) -> Node:
    for node in [root, *root.walk()]:
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in NOISE]
    return root


def body(root: Node) -> Node:
    return next((n for n in root.walk() if n.tag == "body"), root)


# Markdown

_INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*"}


def _escaped(text: str) -> str:
    return re.sub(r"([\\`*_\[\]])", r"\\\1", text)


def to_markdown(node: Node) -> str:
    """ATX headings, dashes for lists, fenced code, links and images; blocks apart by a blank line. Post-order over an explicit stack."""
    done: dict[int, str] = {}
    places: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(node, False)]
    while stack:
        n, ready = stack.pop()
        if not ready:
            stack.append((n, True))
            if n.tag == "ol":
                places |= {id(c): k + 1 for k, c in enumerate(c for c in n.elements() if c.tag == "li")}
            stack += [(c, False) for c in n.elements()]
            continue
        if n.tag == "pre":
            done[id(n)] = f"\n\n```\n{n.text().strip(chr(10))}\n```\n\n"
            continue
        parts = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(_escaped(re.sub(r"[ \t\r\n]+", " ", c)))
            else:
                parts.append(done.pop(id(c), ""))
        done[id(n)] = _rendered(n, "".join(parts), places.pop(id(n), None))
    return done[id(node)]


def _tight(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text)).strip()


def _rendered(n: Node, inner: str, place: int | None = None) -> str:
    tag = n.tag
    if re.fullmatch(r"h[1-6]", tag):
        one = " ".join(inner.split())
        return f"\n\n{'#' * int(tag[1])} {one}\n\n" if one else ""
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        src = n.attrs.get("src") or ""
        return f"![{n.attrs.get('alt') or ''}]({src})" if src else ""
    if tag == "a" and n.attrs.get("href") and inner.strip():
        return f"[{' '.join(inner.split())}]({n.attrs['href']})"
    if tag in _INLINE and inner.strip():
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return f"{lead}{_INLINE[tag]}{inner.strip()}{_INLINE[tag]}{tail}"
    if tag == "code":
        return f"`{n.text()}`" if n.text() else ""
    if tag == "li":
        mark = f"{place}. " if place else "- "
        held = re.sub(r"\n{2,}(?=- |\d+\. )", "\n", _tight(inner))
        return "\n" + mark + held.replace("\n", "\n" + " " * len(mark)) + "\n"
    if tag in ("ul", "ol"):
        return f"\n\n{re.sub(chr(10) + '{2,}(?=- |[0-9]+[.] )', chr(10), inner).strip(chr(10))}\n\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in _tight(inner).split("\n")) + "\n\n"
    if tag in ("td", "th"):
        return f" {_tight(inner)} |"
    if tag == "tr":
        return f"\n|{inner.strip(chr(10))}"
    return f"\n\n{inner.strip(' ')}\n\n" if tag in BLOCK else inner


def collapsed(md: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", md)).strip()


def html_markdown(html: str, max_chars: int = 5_000_000) -> str:
    return collapsed(to_markdown(body(pruned(parse(html)))))[:max_chars]


# cards


def signature(n: Node) -> str:
    return ".".join([n.tag, *sorted(set((n.attrs.get("class") or "").split()))])


def repeated_cards(top: Node) -> tuple[Node, list[Node]] | None:
    """The container and members of the best group of like children: at least three; most, then most text, then first on a depth-first walk from the last child."""
    best, stack = None, [top]
    while stack:
        n = stack.pop()
        groups: dict[str, list[Node]] = {}
        for c in n.elements():
            groups.setdefault(signature(c), []).append(c)
            stack.append(c)
        for members in groups.values():
            if len(members) >= LEAST_CARDS:
                rank = (len(members), sum(len(m.text()) for m in members))
                if best is None or rank > best[0]:
                    best = (rank, n, members)
    return best and (best[1], best[2])


def structural_chunks(html: str, size: int = SIZE, most: int | None = MOST) -> dict:
    """full_text, chunks (text, start, end), card_count, structural, truncated of a page: cards batched up to `size`, never split; a heading outside them goes first.

    Batches beyond `most` (None: none is) are left out and counted in truncated.
    """
    return chunks_of(parse(html), size, most)


def chunks_of(root: Node, size: int = SIZE, most: int | None = MOST) -> dict:
    """`structural_chunks` of a tree, which is pruned."""
    top = body(pruned(root))
    found = repeated_cards(top)
    texts: list[str] = []
    if found:
        container, cards = found
        members, held = set(map(id, cards)), ""
        inside = {id(x) for x in container.walk()} | {id(container)}
        for c in container.elements():
            piece = collapsed(to_markdown(c))
            if not piece:
                continue
            if id(c) in members and held and len(held) + 2 + len(piece) > size:
                texts.append(held)
                held = ""
            held = f"{held}\n\n{piece}" if held else piece
        texts.append(held)
        head = next((n for n in top.walk() if n.tag == "h1" and id(n) not in inside), None)
        if head is not None and collapsed(to_markdown(head)):
            texts[0] = f"{collapsed(to_markdown(head))}\n\n{texts[0]}".strip()
    kept = [t for t in texts if t]
    if not kept:
        return {"full_text": collapsed(to_markdown(top))[:5_000_000], "chunks": [], "card_count": 0, "structural": False, "truncated": 0}
    chunks, at = [], 0
    for t in kept[:most]:
        chunks.append((t, at, at + _u16(t)))
        at += _u16(t) + 2
    return {
        "full_text": "\n\n".join(kept[:most]), "chunks": chunks, "card_count": len(found[1]), "structural": True, "truncated": len(kept) - len(kept[:most])
    }


def _u16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


# embedded state


def balanced_json(source: str, at: int) -> str | None:
    """The object or array that begins at or after white space from `at`; brackets in strings don't count."""
    while at < len(source) and source[at].isspace():
        at += 1
    if at >= len(source) or source[at] not in "{[":
        return None
    opening, closing = source[at], "}" if source[at] == "{" else "]"
    depth, quoted, k = 0, False, at
    while k < len(source):
        c = source[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return source[at : k + 1]
        k += 1
    return None


def _loaded(raw: str, code: str, label: str, most: int, warnings: list[str]):
    if len(raw) > RAW_CHARS:
        warnings.append(f"embedded-state-size-capped: skipped an oversized {label} ({len(raw)} chars > {RAW_CHARS})")
        return None
    try:
        value = json.loads(raw, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
    except (ValueError, RecursionError) as e:
        warnings.append(f"{code}: {e}")
        return None
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if len(text) > most:
        warnings.append(f"embedded-state-size-capped: {label} exceeded {most} chars")
        return None
    return text


_ASSIGN = re.compile(r"(?:\bwindow\s*\.\s*)?__(?:INITIAL|PRELOADED)_STATE__\s*=\s*")


def embedded_state(html: str) -> dict:
    """json_ld (JSON texts), next_data, initial_state, warnings of a page's scripts."""
    return state_of(parse(html))


def state_of(root: Node) -> dict:
    scripts = [n for n in root.walk() if n.tag == "script"]
    warnings: list[str] = []
    kept, total = [], 0
    for n in scripts:
        raw = n.text().strip()
        if (n.attrs.get("type") or "").strip().lower() != "application/ld+json" or not raw:
            continue
        if len(kept) >= JSONLD_BLOCKS:
            warnings.append(f"embedded-state-size-capped: dropped JSON-LD blocks beyond {JSONLD_BLOCKS}")
            break
        text = _loaded(raw, "embedded-jsonld-parse-failed", "JSON-LD block", JSONLD_CHARS, warnings)
        if text is None:
            continue
        if total + len(text) > JSONLD_CHARS:  # a smaller one may still fit
            warnings.append(f"embedded-state-size-capped: JSON-LD total exceeded {JSONLD_CHARS} chars")
            continue
        total += len(text)
        kept.append(text)
    following = next((n.text().strip() for n in scripts if (n.attrs.get("id") or "").strip() == "__NEXT_DATA__" and n.text().strip()), None)
    next_data = _loaded(following, "embedded-nextdata-parse-failed", "__NEXT_DATA__ block", STATE_CHARS, warnings) if following else None
    initial = None
    for n in scripts:
        m = None if "src" in n.attrs else _ASSIGN.search(n.text().strip())
        raw = m and balanced_json(n.text().strip(), m.end())
        if raw:
            initial = _loaded(raw, "embedded-initialstate-parse-failed", "hydration blob", STATE_CHARS, warnings)
            if initial is not None:
                break
    return {"json_ld": kept, "next_data": next_data, "initial_state": initial, "warnings": warnings}


def same_host_links(html: str, url: str) -> list[str]:
    """Links of the page's own origin, absolute, without fragments, in document order."""
    try:
        here = urlsplit(url)
        out = []
        for n in parse(html).walk():
            if n.tag == "a" and n.attrs.get("href") is not None:
                to = urlsplit(urljoin(url, n.attrs["href"].strip()))
                if to.scheme in ("http", "https") and (to.scheme, to.netloc.lower()) == (here.scheme, here.netloc.lower()):
                    out.append(to._replace(fragment="", path=to.path or "/").geturl())
        return out
    except ValueError:
        return []


def _cards(html: str | None, size: int, most: int | None) -> dict:
    return _named(structural_chunks(html or "", size, most))


def _named(found: dict) -> dict:
    """With chunks as dicts."""
    return found | {"chunks": [{"text": t, "start": s, "end": e} for t, s, e in found["chunks"]]}


_CARDS = "full_text:string,chunks:array<struct<text:string,start:bigint,end:bigint>>,card_count:int,structural:boolean,truncated:int"
_STATE = "json_ld:array<string>,next_data:string,initial_state:string,warnings:array<string>"


# the columns; made on call, as workers import this module without a session


def markdown(html: Column) -> Column:
    return sliced(lambda html: [html_markdown(x) if x is not None else None for x in html], "string")(html)


def cards(html: Column, size: int = SIZE, most: int | None = MOST) -> Column:
    """Struct (full_text, chunks (text, start, end), card_count, structural, truncated)."""
    return sliced(lambda html: [_cards(x, size, most) for x in html], f"struct<{_CARDS}>")(html)


def state(html: Column) -> Column:
    """Struct (json_ld, next_data, initial_state, warnings), JSON as text."""
    return sliced(lambda html: [embedded_state(x or "") for x in html], f"struct<{_STATE}>")(html)


def links(html: Column, url: Column) -> Column:
    return sliced(lambda html, url: [same_host_links(h or "", u or "") for h, u in zip(html, url)], "array<string>")(html, url)


def page(html: Column, size: int = SIZE, most: int | None = MOST) -> Column:
    """Struct (cards, state, problem) of pages, parsed once: what `cards` and `state` give; a page that can't be converted has the problem instead of cards."""

    def both(x: str | None) -> dict:
        root, problem, found = parse(x or ""), None, None
        held = state_of(root)
        try:
            found = _named(chunks_of(root, size, most))
        except Exception as e:  # the caller falls back to plain text
            problem = str(e)
        return {"cards": found, "state": held, "problem": problem}

    return sliced(lambda html: [both(x) for x in html], f"struct<cards:struct<{_CARDS}>,state:struct<{_STATE}>,problem:string>")(html)
