"""Calling a provider on the chunks of each run, within budgets.

A provider is a Python object that every task can hold (it is pickled): `name`, `extract(request) -> outcome`, and maybe
`extract_batch(requests) -> outcomes`, `capabilities`, `max_batch`. A request is a dict (content, content_type, schema, hints); an outcome a dict
(proposals: list of dicts, model, response, tokens, warnings) or an exception raised.

Budgets are of a run, so the chunks of a run are in one partition, in order, and its waves go one after another: before a wave, the
ceilings are checked; its calls count from then on, its tokens when it is done. Runs are independent and spread over all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gristmill.functions.batches import slices
from gristmill.functions.canonical import stable

#: OUT_ROWS: outcomes and proposals that are held before they leave.
CALL_CHARS, OUT_ROWS = 32_000, 1000


class Provider(Protocol):
    name: str

    def extract(self, request: dict) -> dict: ...


@dataclass
class Options:
    max_calls: int | None = None
    max_tokens: float | None = None
    concurrency: int = 1
    batch: int = 1
    call_chars: int = CALL_CHARS
    hints: dict[str, str] = field(default_factory=dict)
    guidance: str | None = None
    examples: list[dict] = field(default_factory=list)

    def error(self) -> str | None:
        """What is wrong with the options, as a result's error; the first that is."""
        if self.max_calls is not None and (not isinstance(self.max_calls, int) or self.max_calls < 1):
            return f"invalid maxProviderCalls: must be a positive integer (got {self.max_calls})"
        if self.max_tokens is not None and not 0 < self.max_tokens < float("inf"):
            return f"invalid maxTotalTokens: must be a positive finite number (got {self.max_tokens})"
        for name, value in (("concurrency", self.concurrency), ("batchSize", self.batch)):
            if not isinstance(value, int) or value < 1:
                return f"invalid {name}: must be a positive integer (got {value})"
        return None


def u16_head(text: str, n: int) -> str:
    """The first n UTF-16 units of a text; a character that would be split is left out."""
    if len(text) <= n and (text.isascii() or len(text) * 2 <= n):
        return text
    return text.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore")


def u16_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _outcomes(provider: Provider, requests: list[dict]) -> list[dict | Exception]:
    try:
        if len(requests) > 1 and hasattr(provider, "extract_batch"):
            got = provider.extract_batch(requests)
            if not isinstance(got, list) or len(got) != len(requests):
                n = len(got) if isinstance(got, list) else "non-array"
                raise ValueError(f"provider batch returned {n} outcome(s) for {len(requests)} input(s)")
            return got
        return [provider.extract(requests[0])]
    except Exception as e:  # a provider may fail in any way; the run goes on
        return [e] * len(requests)


def run_waves(provider: Provider, chunks: list[dict], content_type: str, schema: list[dict], o: Options, cancelled=lambda: False):
    """(outcome of each chunk that was sent, calls, tokens, stop) for the ordered chunks of one run; stop is None or (reason, remaining)."""
    bulk = o.batch if hasattr(provider, "extract_batch") else 1
    bulk = max(1, min(bulk, getattr(provider, "max_batch", bulk)))
    out: dict[int, dict | Exception] = {}
    at = calls = tokens = 0
    stop = None
    while at < len(chunks):
        reason = (
            "cancelled" if cancelled()
            else "max-provider-calls" if o.max_calls is not None and calls >= o.max_calls
            else "max-total-tokens" if o.max_tokens is not None and tokens >= o.max_tokens
            else None
        )
        if reason:
            stop = (reason, len(chunks) - at)
            break
        slots = o.concurrency if o.max_calls is None else min(o.concurrency, o.max_calls - calls)
        wave = []
        while at < len(chunks) and len(wave) < slots:
            wave.append(list(range(at, min(at + bulk, len(chunks)))))
            at = wave[-1][-1] + 1
        calls += len(wave)
        asked = [
            [{"content": u16_head(chunks[i]["chunk"], o.call_chars), "content_type": content_type, "schema": schema, "hints": o.hints, "guidance": o.guidance, "examples": o.examples} for i in group]
            for group in wave
        ]
        if len(wave) == 1:
            answers = [_outcomes(provider, asked[0])]
        else:
            with ThreadPoolExecutor(len(wave)) as pool:
                answers = list(pool.map(lambda r: _outcomes(provider, r), asked))
        for group, got in zip(wave, answers):
            for i, x in zip(group, got):
                out[i] = x
                if isinstance(x, dict) and isinstance(x.get("tokens"), (int, float)):
                    tokens += int(x["tokens"])
    return out, calls, tokens, stop


def _items(raw) -> list[dict]:
    rows = []
    for k, x in enumerate(raw if isinstance(raw, list) else []):
        is_object = isinstance(x, dict)
        x = x if is_object else {}
        confidence = x.get("confidence")
        hint = x.get("occurrence_hint")
        rows.append(
            {
                "item": k, "is_object": is_object, "field_path": x.get("field_path") if isinstance(x.get("field_path"), str) else None, "value_json": json.dumps(x.get("value"), ensure_ascii=False),
                "value_canon": stable(x.get("value")), "confidence": float(confidence) if isinstance(confidence, (int, float)) and not isinstance(confidence, bool) else None,
                "excerpt": x.get("excerpt") if isinstance(x.get("excerpt"), str) else None, "extractor": x.get("extractor") if isinstance(x.get("extractor"), str) else None,
                "occurrence_hint": hint if isinstance(hint, int) and not isinstance(hint, bool) and abs(hint) < 2**31 else None,
            }
        )
    return rows


def dispatched(chunks: DataFrame, provider: Provider, schema: list[dict], options: Options | None = None, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
    """One row per chunk that was sent, with its outcome and the run's totals, of `chunks` (run_id, chunk_idx, start, chunk, content_type).

    run_id is of any type that can be ordered. `cancelled` is asked before every wave, in the tasks; it has to be a callable that they can hold. Reading the result calls the provider: write
    it before it is read twice.
    """
    o = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def solve(rows: list[dict]) -> list[dict]:
            got, calls, tokens, stop = run_waves(provider, rows, rows[0]["content_type"], schema, o, cancelled)
            out = []
            for i, r in enumerate(rows):
                x = got.get(i)
                if x is None:
                    continue
                bad = isinstance(x, Exception)
                warnings = [] if bad else list(x.get("warnings") or [])
                late = not bad and not isinstance(x.get("proposals"), list)
                used = None if bad else x.get("tokens")
                out.append(
                    {
                        "run_id": r["run_id"], "chunk_idx": r["chunk_idx"], "n_chunks": len(rows), "ok": not bad, "model": None if bad else x.get("model"), "response": None if bad else x.get("response"),
                        "tokens": int(used) if isinstance(used, (int, float)) and not isinstance(used, bool) else None, "error": str(x) if bad else None, "status": getattr(x, "status", None) if bad else None,
                        "code": getattr(x, "code", None) if bad else None, "retryable": getattr(x, "retryable", None) if bad else None, "warnings": warnings,
                        "no_list": late, "proposals": [] if bad else _items(x.get("proposals")), "start": r["start"],
                        "end": r["start"] + u16_size(u16_head(r["chunk"], o.call_chars)), "provider_calls": calls, "stop_reason": stop[0] if stop else None, "remaining": stop[1] if stop else 0, "tokens_used": tokens,
                    }
                )
            if not out:  # stopped before the first call: the totals still need a row
                r = rows[0]
                out.append({"run_id": r["run_id"], "chunk_idx": None, "n_chunks": len(rows), "ok": None, "provider_calls": calls, "stop_reason": stop[0] if stop else None, "remaining": stop[1] if stop else 0, "tokens_used": tokens})
            return out

        made: list[dict] = []
        size = 0
        for part in (x for batch in batches for x in slices(batch)):
            for r in part.to_pylist():
                if held and held[0]["run_id"] != r["run_id"]:
                    got = solve(held)
                    made += got
                    size += sum(1 + len(x.get("proposals") or []) for x in got)
                    held = []
                    if size >= OUT_ROWS:
                        yield pa.RecordBatch.from_pylist(made, arrow)
                        made, size = [], 0
                held.append(r)
        if held:
            made += solve(held)
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    schema_text = _SCHEMA.format(kind=chunks.schema["run_id"].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema_text))
    ordered = chunks.select("run_id", "chunk_idx", "start", "chunk", "content_type").repartition("run_id").sortWithinPartitions("run_id", "chunk_idx")
    return ordered.mapInArrow(run, schema_text)


_PROPOSAL = "struct<item:int,is_object:boolean,field_path:string,value_json:string,value_canon:string,confidence:double,excerpt:string,extractor:string,occurrence_hint:int>"
_SCHEMA = (
    "run_id {kind}, chunk_idx int, n_chunks int, ok boolean, model string, response string, tokens bigint, error string, status int, code string, retryable boolean, "
    f"warnings array<string>, no_list boolean, proposals array<{_PROPOSAL}>, start bigint, end bigint, provider_calls bigint, stop_reason string, remaining int, tokens_used bigint"
)
