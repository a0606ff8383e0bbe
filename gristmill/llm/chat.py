"""Transcript parsing with a hidden Markov model, and canonical rendering.

The lines of a conversation, in the order of its rows and of the lines in each, are what is observed. A line's symbol
combines its speaker marker (`User:`, `### Assistant`, `<|system|>`, ...), whether it opens a row, its length class, a question at
its end, and whether the line before it is blank. The hidden states are a role with `begins a turn` or `goes on`. All
probabilities are counted over the rows whose role is known, with small pseudo-counts. As a conversation may come as a row a message, as one text with
markers, or as one without, the lines are counted in all three forms, the latter two with their rows joined. The likeliest path by Viterbi gives each
line its role and where turns begin; the marker is cut off, and turns are rendered in one form.

The recovered roles never look at the role column of the conversation itself: it only counts in the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kind_of

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in ROLES for b in (True, False)]
#: The words that mark a speaker, by role; `other` names nobody known.
NAMES = {
    "system": "system|context|instructions?",
    "user": "user|human|customer|question|q|you",
    "assistant": "assistant|ai|bot|agent|model|answer|a|gpt",
}
_ANY = "|".join(NAMES.values())
MARKER = rf"(?i)^\s*(?:<\|(?:im_start\|>)?|\[|\*\*|#{{1,4}}\s*)?({_ANY})(?:\|>|\]\s*:?|:\*\*|\*\*\s*:|\s*:)(?:\s+|$)|(?i)^\s*#{{2,4}}\s*({_ANY})\s*$"
_MARKER = re.compile(MARKER.replace("|(?i)^", "|^"))
LENGTHS = (0, 20, 40, 80, 120, 160, 200, 250, 300, 400, 600, 1000)
N_SYMBOLS = 4 * 2 * (len(LENGTHS) + 1) * 2 * 2
SMOOTH = 0.05


def marker_of(line: str) -> tuple[int, int]:
    """(0 for none or 1 + the role's index, where the line's text begins)."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    name = (m.group(1) or m.group(2)).lower()
    role = next(k for k, r in enumerate(ROLES) if re.fullmatch(NAMES[r], name))
    return 1 + role, m.end()


def symbol(line: str, opens: bool, before: str | None) -> int:
    marker, at = marker_of(line)
    rest = line[at:].strip()
    size = sum(len(rest) > n for n in LENGTHS)
    question = rest.endswith("?")
    blank = before is not None and not before.strip()
    return (((marker * 2 + opens) * (len(LENGTHS) + 1) + size) * 2 + question) * 2 + blank


def row_symbols(text: str | None) -> list[int]:
    lines = (text or "").split("\n")
    return [symbol(x, k == 0, lines[k - 1] if k else None) for k, x in enumerate(lines)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's counts of (role, begins, symbol) over rows of a known role."""
    counts = np.zeros((len(STATES), N_SYMBOLS), np.int64)
    inner = np.zeros(len(ROLES), np.int64)
    for batch in batches:
        for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if role not in ROLES:
                continue
            r = ROLES.index(role)
            for k, s in enumerate(row_symbols(text)):
                counts[2 * r + (k > 0), s] += 1
                inner[r] += k > 0
    state, sym = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(state, pa.int32()), pa.array(sym, pa.int32()), pa.array(counts[state, sym], pa.int64())], ["state", "symbol", "n"]
    )


class Model:
    """Logarithms of the start (states), transition (states, states) and emission (states, symbols) probabilities."""

    def __init__(self, emitted: np.ndarray, follows: np.ndarray, starts: np.ndarray):
        rest = emitted.reshape(len(STATES), 8, -1).sum(1) + SMOOTH
        rest /= rest.sum(1, keepdims=True)
        place = np.zeros((len(STATES), 4, 2))
        for s, (role, begins) in enumerate(STATES):
            rows = emitted[s].reshape(4, 2, -1).sum(2)
            joined, marked = rows, rows
            if begins:
                # of rows that are joined, the first of a conversation alone opens one
                r = ROLES.index(role)
                first = min(1.0, starts[r] / max(rows.sum(), 1))
                opens = np.array([1 - first, first])
                joined = rows.sum(1)[:, None] * opens
                marked = np.zeros((4, 2))
                marked[1 + r] = rows.sum() * opens
            place[s] = rows + joined + marked
        place += SMOOTH
        place /= place.sum((1, 2), keepdims=True)
        self.emission = np.log((place.reshape(len(STATES), 8, 1) * rest[:, None, :]).reshape(len(STATES), -1))
        turn = follows + SMOOTH * 10
        turn = turn / turn.sum(1, keepdims=True)
        go = np.zeros((len(STATES), len(STATES)))
        for s, (role, begins) in enumerate(STATES):
            r = ROLES.index(role)
            first, rest = emitted[2 * r].sum(), emitted[2 * r + 1].sum()
            stay = (rest + 1) / (first + rest + 2)
            for t, (to, starts_turn) in enumerate(STATES):
                if starts_turn:
                    go[s, t] = (1 - stay) * turn[r, ROLES.index(to)]
                elif to == role:
                    go[s, t] = stay
        with np.errstate(divide="ignore"):
            self.transition = np.log(go)
            start = np.zeros(len(STATES))
            start[::2] = (starts + SMOOTH * 10) / (starts + SMOOTH * 10).sum()
            self.start = np.log(start)


def train(conversations: DataFrame) -> Model:
    """The model of (conv_id, turn, role, text): all rows whose role is one of ROLES."""
    emitted = np.zeros((len(STATES), N_SYMBOLS))
    rows = conversations.select("role", "text").mapInArrow(_count, "state int, symbol int, n bigint")
    for r in rows.groupBy("state", "symbol").agg(F.sum("n").alias("n")).collect():  # at most states x symbols
        emitted[r["state"], r["symbol"]] = r["n"]
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn", "text"))
    pairs = (
        conversations.select(before.alias("a"), F.col("role").alias("b"))
        .where(F.col("b").isin(*ROLES) & (F.col("a").isNull() | F.col("a").isin(*ROLES)))
        .groupBy("a", "b")
        .count()
        .collect()
    )
    follows, starts = np.zeros((3, 3)), np.zeros(3)
    for r in pairs:
        if r["a"] is None:
            starts[ROLES.index(r["b"])] = r["count"]
        else:
            follows[ROLES.index(r["a"]), ROLES.index(r["b"])] = r["count"]
    return Model(emitted, follows, starts)


def viterbi(model: Model, sequences: list[list[int]]) -> list[np.ndarray]:
    """The likeliest states of each sequence; on ties the state listed first."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    for at in range(0, len(order), 512):
        some = order[at : at + 512]
        lengths = np.array([len(sequences[k]) for k in some])
        width = int(lengths[0])
        if not width:
            continue
        padded = np.zeros((len(some), width), np.int64)
        for row, k in enumerate(some):
            padded[row, : lengths[row]] = sequences[k]
        score = model.start + model.emission[:, padded[:, 0]].T
        back = np.zeros((width, len(some), len(STATES)), np.int8)
        final = score.copy()
        for p in range(1, width):
            n = int((lengths > p).sum())
            via = score[:n, :, None] + model.transition[None]
            back[p, :n] = via.argmax(1)
            score = via.max(1) + model.emission[:, padded[:n, p]].T
            final[:n] = score
        state = final.argmax(1)
        path = np.zeros((len(some), width), np.int64)
        for row in range(len(some)):
            s = int(state[row])
            for p in range(int(lengths[row]) - 1, -1, -1):
                path[row, p] = s
                s = int(back[p, row, s])
            out[some[row]] = path[row, : lengths[row]]
    return out


def turns(rows: list[str | None], states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn; markers are cut off the lines that begin one."""
    out: list[tuple[str, list[str]]] = []
    lines = [x for text in rows for x in (text or "").split("\n")]
    for line, s in zip(lines, states):
        role, begins = STATES[int(s)]
        if begins or not out:
            marker, at = marker_of(line)
            out.append((role, [line[at:] if marker else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(x).strip()) for role, x in out]


def escape(text: str) -> str:
    """Text in which no canonical mark occurs."""
    return text.replace("<|", "<​|")


def render(parsed: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{escape(text)}\n<|end|>\n" for role, text in parsed)


def _parse(model: Model):
    def solve(groups: list[tuple[object, list[str | None]]], kind: pa.DataType) -> pa.RecordBatch:
        paths = viterbi(model, [[s for t in rows for s in row_symbols(t)] for _, rows in groups])
        parsed = [turns(rows, path) for (_, rows), path in zip(groups, paths)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in groups], kind),
                pa.array([len(p) for p in parsed], pa.int32()),
                pa.array([[r for r, _ in p] for p in parsed], pa.list_(pa.string())),
                pa.array([render(p) for p in parsed], pa.string()),
            ],
            ["conv_id", "n_turns", "roles", "rendered"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[object, list[str | None]]] = []
        kind = None
        held = 0
        for batch in batches:
            kind = batch.column(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not groups or groups[-1][0] != conv:
                    if held > 4_000_000:
                        yield solve(groups, kind)
                        groups, held = [], 0
                    groups.append((conv, []))
                groups[-1][1].append(text)
                held += len(text or "")
        if groups:
            yield solve(groups, kind)

    return run


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """(conv_id, n_turns, roles, rendered): one row a conversation, roles recovered from its lines alone.

    `conversations` (conv_id, turn, role, text, ...): a row is a message or a transcript of several, with or without markers. Rows go by
    turn, those of null turn first, ties by text; repeated rows stay. A null text is an empty line; null conv_ids are one
    conversation. Unknown and null roles don't count in the model, and with no known role markers and the smoothing
    decide. `<|` in a text is broken up, so that rendering can be read back. conv_id is of any type that can be ordered; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    model = model or train(conversations)
    lines = conversations.select("conv_id", "turn", "text")
    schema = f"conv_id {kind_of(conversations, 'conv_id')}, n_turns int, roles array<string>, rendered string"
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").select("conv_id", "text").mapInArrow(_parse(model), schema)
