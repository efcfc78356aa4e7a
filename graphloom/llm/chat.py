"""Chat formatting by schema fingerprints (operator 3).

A record is JSON of any layout. The set of its nested field paths (``messages[].role``)
is hashed to a fingerprint, and the fingerprint selects a declarative mapping that says
where turns, roles and texts are; a path set with further fields goes to the first mapping
whose required paths it holds. Mapped turns are rendered in a template that marks
turns, with control strings inside texts escaped reversibly, together with the spans of
the rendered text that carry loss (the texts of assistant turns).

Defined results: null or missing texts and roles are empty; values that are not strings
are rendered as JSON; a turn that is not an object is a text without a role; text that is no JSON, or too deep to walk, is an empty record; a record of unknown layout has no
turns and an ``unknown`` layout; rows of one conversation are ordered by turn (null
first), then role, then text, so ties and repeated rows have one result; a null
conversation id is a conversation; an empty table gives an empty result; other columns
are ignored.

Scale: one shuffle by conversation, which is the unit of output and has to be whole;
everything else is row-local.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

START, END = "<|im_start|>", "<|im_end|>"


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value, ``[]`` for any element of a list."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """Either a list of turns under ``turns`` with ``role`` and ``text`` fields, or single
    ``fields``, each with the role it speaks for, in order; empty optional ones are left out. Other
    fields of a record are let be."""

    name: str
    turns: str | None = None
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        if self.turns:
            return [fingerprint({f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}), fingerprint({f"{self.turns}[]"})]
        must = {f for f, _ in self.fields} - set(self.optional)
        sets = [must]
        for o in self.optional:
            sets += [s | {o} for s in sets]
        return [fingerprint(s) for s in sets]

    def takes(self, found: set[str]) -> bool:
        """Whether the required paths are among those found."""
        if self.turns:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"} <= found or f"{self.turns}[]" in found
        return {f for f, _ in self.fields} - set(self.optional) <= found

    def map(self, record: dict) -> list[tuple[str, str]]:
        if self.turns:
            given = record.get(self.turns)
            turns = [t if isinstance(t, dict) else {self.text: t} for t in (given if isinstance(given, list) else [])]
            said = [(plain(t.get(self.role)), plain(t.get(self.text))) for t in turns]
            return [(self.roles.get(role, role), text) for role, text in said]
        said = [(f, role, plain(record.get(f))) for f, role in self.fields]
        return [(role, text) for f, role, text in said if text or f not in self.optional]


def plain(value) -> str:
    """A text as it is, null and empty values as an empty one, other values as JSON; halves of
    surrogate pairs, which UTF-8 cannot hold, as U+FFFD."""
    if not isinstance(value, str):
        value = "" if value is None or value == {} or value == [] else json.dumps(value, ensure_ascii=False)
    try:
        value.encode()
        return value
    except UnicodeEncodeError:
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


#: Mappings in use; more can be passed to the functions below.
LAYOUTS = (
    Layout("messages", "messages", "role", "content"),
    Layout("exchange", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Layout("prompt", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("question", fields=(("question", "user"), ("answer", "assistant"))),
)


def canonical(record_json: str | None, known: dict[str, Layout], layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[str, str, list[tuple[str, str]]]:
    """(fingerprint, layout name, turns) of one record."""
    try:
        record = json.loads(record_json) if record_json else {}
        found = paths(record)
    except (ValueError, RecursionError):  # no JSON, or nested beyond what can be walked
        record, found = {}, paths({})
    mark = fingerprint(found)
    layout = known.get(mark) or next((x for x in layouts if x.takes(found)), None)
    if layout is None or not isinstance(record, dict):
        return mark, "unknown", []
    try:
        return mark, layout.name, layout.map(record)
    except RecursionError:
        return mark, "unknown", []


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash more stands between the two characters."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The template's text, and the code-point spans of it that carry loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role.replace('\\', '\\\\').replace(chr(10), '\\n'))}\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        cut = formatted.index("\n", at)
        end = formatted.index(END + "\n", cut)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(formatted[at + len(START) : cut]))
        turns.append((role, unescape(formatted[cut + 1 : end])))
        at = end + len(END) + 1
    return turns


FORMATTED = "formatted string, loss array<struct<start:int,end:int>>, layout string, schema_fingerprint string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_records(records: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(id, formatted, loss, layout, schema_fingerprint)`` of every JSON record."""
    known = {f: x for x in reversed(layouts) for f in x.fingerprints()}
    rows = records.select(F.col(id_col).alias("id"), F.col(json_col).alias("record"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans, names, marks = [], [], [], []
        for x in batch.column("record").to_pylist():
            mark, name, turns = canonical(x, known, layouts)
            text, loss = render(turns)
            texts.append(text)
            spans.append([{"start": s, "end": e} for s, e in loss])
            names.append(name)
            marks.append(mark)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(spans, _SPANS), pa.array(names, pa.string()), pa.array(marks, pa.string())], ["id", "formatted", "loss", "layout", "schema_fingerprint"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {FORMATTED}")


def records_of(conversations: DataFrame) -> DataFrame:
    """``(id, record)``: each conversation as JSON. A user turn and an assistant turn alone
    become an instruction record, other conversations with an odd id an exchange record,
    the rest a message list, so that all three kinds of layout pass through the mappings."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    t = F.col("turns")
    said = lambda name, text, roles=None: F.transform(t, lambda x: F.struct((roles(x["role"]) if roles else x["role"]).alias(name), x["text"].alias(text)))
    spoken = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    plain = ~F.exists(t, lambda x: x["role"].isin("human", "gpt"))
    pair = (F.size(t) == 2) & (F.get(t, F.lit(0))["role"] == "user") & (F.get(t, F.lit(1))["role"] == "assistant")
    record = (
        F.when(pair, F.to_json(F.struct(F.get(t, F.lit(0))["text"].alias("instruction"), F.get(t, F.lit(1))["text"].alias("output"))))
        .when(plain & (F.pmod(F.col("conv_id"), F.lit(2)) == 1), F.to_json(F.struct(said("from", "value", spoken).alias("conversations"))))
        .otherwise(F.to_json(F.struct(said("role", "content").alias("messages"))))
    )
    return whole.select(F.col("conv_id").alias("id"), record.alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the rendered text says when it is read back."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = read_back(text)
            masked = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
        kinds = (("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], batch.column("layout"), batch.column("schema_fingerprint")], ["conv_id", *[n for n, _ in kinds], "layout", "schema_fingerprint"])

    kind = formatted.schema["id"].dataType.simpleString()
    return arrow_map(formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string, schema_fingerprint string")
