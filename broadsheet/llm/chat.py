"""Chat formatting: heterogeneous records to canonical turns by schema fingerprints, then to a template.

A record is a JSON object of any layout. Its fingerprint is the hash of the sorted set of its nested field paths
(list items share the path ``[]``; values do not count). A registry maps fingerprints to declarative mappings, each of which
says where turns, roles and texts lie; records of an unknown fingerprint are kept and marked as unmapped.

The template writes a turn as ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks). Inside texts and roles every ``<``, ``n``
backslashes, ``|`` gets one backslash more, so no marker can occur there and the text can be got back. A turn is a
piece of output of its own, with the span of it that the loss covers (texts of the assistant), so that a conversation
of any length is never held as a whole.

Defined results: null text and null role are empty; null conversation ids form one conversation; turns with equal
numbers are ordered by role and text (a piece carries its place in the conversation); repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
PIECES = "conv_id long, turn long, piece int, role string, text string, layout string"
FORMATTED = "conv_id long, ord long, turn long, piece int, formatted string, loss_start int, loss_end int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Turn:
    """One turn of a layout. ``text``: paths whose non-empty values are joined by a blank line; ``role`` or ``role_at``."""

    text: tuple[str, ...]
    role: str | None = None
    role_at: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. ``paths``: the field paths of its records; ``optional``: paths that may be missing."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Turn, ...]
    each: str | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


#: Names of roles in the wild, by the canonical one.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

LAYOUTS = (
    Layout("turn_row", ("role", "text", "turn"), (Turn(("text",), role_at="role"),)),
    Layout("content_row", ("content", "role", "turn"), (Turn(("content",), role_at="role"),)),
    Layout("value_row", ("from", "turn", "value"), (Turn(("value",), role_at="from"),)),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), (Turn(("content",), role_at="role"),), each="messages", roles=ROLES),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), (Turn(("value",), role_at="from"),), each="conversations", roles=ROLES),
    Layout(
        "instruction",
        ("instruction", "output"),
        (Turn(("system",), role="system", optional=True), Turn(("instruction", "input"), role="user"), Turn(("output",), role="assistant")),
        optional=("input", "system"),
    ),
    Layout("prompt_completion", ("completion", "prompt"), (Turn(("prompt",), role="user"), Turn(("completion",), role="assistant"))),
    Layout("prompt_response", ("prompt", "response"), (Turn(("system",), role="system", optional=True), Turn(("prompt",), role="user"), Turn(("response",), role="assistant")), optional=("system",)),
    Layout("question_answer", ("answer", "question"), (Turn(("question",), role="user"), Turn(("answer",), role="assistant"))),
    Layout("nested_data", ("data", "data.messages", "data.messages[].content", "data.messages[].role"), (Turn(("content",), role_at="role"),), each="data.messages", roles=ROLES),
)


def field_paths(value: object, prefix: str = "") -> set[str]:
    """The nested field paths of a JSON value."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{prefix}.{k}" if prefix else k
            out.add(path)
            out |= field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            out |= field_paths(v, prefix + "[]")
    return out


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint -> layout, with each choice of a layout's optional paths, and with empty lists of turns."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for k in range(1 << len(layout.optional)):
            more = {p for i, p in enumerate(layout.optional) if k >> i & 1}
            out[fingerprint(set(layout.paths) | more)] = layout
            if layout.each:
                out[fingerprint({p for p in layout.paths if "[]" not in p} | more)] = layout
    return out


def _at(record: object, path: str) -> object:
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def _string(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: object, known: dict[str, Layout]) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name (None: unknown) and (role, text) turns of a record."""
    layout = known.get(fingerprint(field_paths(record))) if isinstance(record, dict) else None
    if layout is None:
        return None, []
    items = _at(record, layout.each) if layout.each else [record]
    out = []
    for item in items if isinstance(items, list) else []:
        for turn in layout.turns:
            text = "\n\n".join(x for p in turn.text if (x := _string(_at(item, p))))
            if turn.optional and not text:
                continue
            role = turn.role if turn.role_at is None else _string(_at(item, turn.role_at))
            out.append((layout.roles.get(role, role), text))
    return layout.name, out


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The piece of a turn, and the span of it that the loss covers (0, 0: none)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    covered = role == LOSS_ROLE
    return f"{head}{body}{END}\n", len(head) * covered, (len(head) + len(body)) * covered


def parse_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a piece."""
    if not piece.startswith(START) or not piece.endswith(END + "\n"):
        raise ValueError("not a turn of this template")
    role, _, text = piece[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(text)


def map_records(df: DataFrame, record_col: str = "record", id_col: str = "conv_id", turn_col: str | None = None) -> DataFrame:
    """JSON records -> canonical turns (PIECES). An unmapped record gives one row with a null layout and itself as text."""
    known = registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                name, turns = canonical_turns(record, known)
                if name is None:
                    rows.append((conv, turn, 0, "", raw or "", None))
                rows += [(conv, turn, i, role, text, name) for i, (role, text) in enumerate(turns)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    turn = F.col(turn_col).cast("long") if turn_col else F.lit(0).cast("long")
    return df.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn"), F.col(record_col).cast("string").alias("record")).mapInArrow(run, PIECES)


def format_turns(turns: DataFrame) -> DataFrame:
    """Canonical turns (PIECES) -> pieces of the template in conversation order (FORMATTED); unmapped records are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place = None, -1  # a conversation lies in one task, its turns follow each other
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                place = place + 1 if conv == key else 0
                key = conv
                places.append(place)
            done = [format_turn(r, t) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            columns = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))]
            front = [batch.column(0), pa.array(places, pa.int64()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(front + columns, names=[f.split()[0] for f in FORMATTED.split(", ")])

    ordered = turns.where("layout IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its pieces hold (DIGEST), parsed back from the template. Streams; holds one turn at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def close() -> pa.RecordBatch:
            n, turns, chars, loss, total = state
            values = (key, n, turns.hexdigest(), chars, loss.hexdigest(), total)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in DIGEST.split(", ")])

        for batch in batches:
            done = []
            for conv, piece, start, end in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                covered = unescape(piece[start:end])
                state[2] += len(covered)
                state[3].update(covered.encode())
                state[4] += len(piece)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield close()

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "ord")
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, DIGEST)
