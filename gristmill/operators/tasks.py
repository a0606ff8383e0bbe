"""Versioned task specifications: small driver-side values with digests of their canonical form."""

from __future__ import annotations

from collections.abc import Callable

from gristmill.functions.canonical import digest, folded

EXAMPLE, TASK = ("content", "content_type", "proposals"), ("version", "target_schema", "guidance", "examples")


def _sha(value) -> str:
    return f"sha256:{digest(value, folded)}"


def _payload(d: dict, keys: tuple[str, ...]) -> dict:
    return {k: d[k] for k in keys if d.get(k) is not None}


def create(task: dict) -> dict:
    """`task` (version, target_schema, guidance, examples) with the digests of its examples and of itself."""
    out = _payload(task, TASK)
    if out.get("examples") is not None:
        out["examples"] = [_payload(e, EXAMPLE) | {"digest": _sha(_payload(e, EXAMPLE))} for e in out["examples"]]
    return out | {"digest": _sha(out)}


def value_matches(value, field: dict) -> bool:
    kind = field["type"]
    if kind in ("string", "date"):
        return isinstance(value, str)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < float("inf")
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "enum":
        return isinstance(value, str) and value in (field.get("enum_values") or [])
    return isinstance(value, list if kind == "array" else dict)


def problem(task: dict, schema: list[dict], prepare: Callable[[str, str], str] = lambda content, kind: content) -> str | None:
    """The first thing that is wrong with a task for a schema, or None. `prepare` turns an example's content into text."""
    if not str(task.get("version") or "").strip():
        return "the task's version is empty"
    if _sha(task.get("target_schema")) != _sha(schema):
        return "the task's schema isn't the target schema"
    if task.get("digest") != _sha(_payload(task, TASK)):
        return "the task's digest isn't that of its content"
    fields = {f["path"]: f for f in schema}
    for k, e in enumerate(task.get("examples") or []):
        if e.get("digest") != _sha(_payload(e, EXAMPLE)):
            return f"example {k}: the digest isn't that of its content"
        try:
            text = prepare(e["content"], e.get("content_type") or "text")
        except Exception as x:
            return f"example {k}: its content can't be prepared: {x}"
        for i, p in enumerate(e["proposals"]):
            if p["field_path"] not in fields:
                return f"example {k}, proposal {i}: unknown field {p['field_path']}"
            if not value_matches(p.get("value"), fields[p["field_path"]]):
                return f"example {k}, proposal {i}: the value isn't of type {fields[p['field_path']]['type']}"
            if not p.get("excerpt") or p["excerpt"] not in text:
                return f"example {k}, proposal {i}: the excerpt isn't in the content"
    return None
