"""Chat formatting: records of many layouts become canonical turns, then one marked text per conversation.

A record's schema fingerprint is the hash of its sorted nested field paths with their kinds. It selects a
declarative mapping - where the turns lie, how role and text are named - from a table; new layouts are new
rows of that table, not code. A record with fields beyond those of a layout is read by the layout of most
paths among those that it has whole, if it loses no text so: fields that hold a text and that the layout does not name
must be names of data about the record (ABOUT: an id, a source, a date), else the record is unknown. The same holds for fields of its
turns. Kinds are checked turn by turn: a turn that is no object, a role that is no text, or a content that is neither a text nor
a list of parts makes the record unknown. Canonical turns go through a template that marks each turn; control strings
inside texts are escaped, so a formatted text can be read back exactly.

Edge cases: a null or empty text is an empty turn; a null role is written as an empty role; ties in turn
order fall back to role and text; repeated rows are repeated turns; a record of an unknown layout, or one that its layout
cannot read whole, keeps its fingerprint and gets no turns; a null conv_id stays null, and no id passes through Python; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batched, values


# --- layouts ------------------------------------------------------------------------------------


def field_paths(value: object) -> set[str]:
    """Nested field paths with the kind of each leaf; array elements share one path."""
    out: set[str] = set()
    held = [("$", value)]
    while held:
        at, v = held.pop()
        if isinstance(v, str) or v is None:
            out.add(at + ":string")
        elif isinstance(v, dict):
            out.add(at + ":object")
            held += [(f"{at}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            out.add(at + ":array")
            held += [(at + "[]", x) for x in v]
        else:
            out.add(at + ":number")
    return out


def hashed(paths: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


def fingerprint(value: object) -> str:
    return hashed(field_paths(value))


@dataclass(frozen=True)
class Mapping:
    """turns: fields that hold one turn each, with its role, in order; many: the field that holds a list of turns."""

    turns: tuple[tuple[str, str], ...] = ()
    many: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    #: A field that holds earlier exchanges, as pairs of a user's and an assistant's text.
    pairs: str | None = None

    def read(self, record: dict) -> list[tuple[str, str]] | None:
        """The turns; None where the record holds texts that the mapping would lose, or values of other kinds."""
        try:
            turns = self._read(record)
            "".join(t for turn in turns for t in turn).encode()  # halves of a character are no text
        except (Unreadable, UnicodeEncodeError):
            return None
        return turns

    def _read(self, record: dict) -> list[tuple[str, str]]:
        known = {field for field, _ in self.turns} | {self.many, self.pairs}
        if any(field not in known and lost(field, value) for field, value in record.items()):
            raise Unreadable
        out: list[tuple[str, str]] = []
        for field, role in self.turns:
            text = said(record.get(field))
            if out and out[-1][0] == role:  # a second field of one speaker goes on with the turn
                out[-1] = role, "\n\n".join(t for t in (out[-1][1], text) if t)
            else:
                out.append((role, text))
        if self.pairs:
            earlier = record.get(self.pairs) or []
            if not isinstance(earlier, list) or not all(isinstance(p, list) and len(p) == 2 for p in earlier):
                raise Unreadable
            at = next((k for k, (role, _) in enumerate(out) if role == "user"), len(out))
            out[at:at] = [turn for a, b in earlier for turn in (("user", said(a)), ("assistant", said(b)))]
        names = dict(self.roles)
        turns = record.get(self.many) if self.many else None
        if not isinstance(turns, list | None):
            raise Unreadable
        for turn in turns or ():
            if not isinstance(turn, dict) or any(field not in (self.role, self.text) and lost(field, value) for field, value in turn.items()):
                raise Unreadable
            role = turn.get(self.role)
            if not isinstance(role, str | None):
                raise Unreadable
            out.append((names.get(role, role) if role else "", said(turn.get(self.text))))
        return out


class Unreadable(Exception):
    """A record that its mapping cannot read whole."""


#: Fields that tell about a record or a turn, and whose texts are not part of the talk.
ABOUT = frozenset("id uid uuid conv_id conversation_id source dataset origin url date created created_at updated_at timestamp time model version lang language license category tags tag type name weight score rating split meta metadata".split())


def lost(field: str, value: object) -> bool:
    """Whether a field without a mapping holds text of the talk."""
    return field not in ABOUT and holds_text(value)


def holds_text(value: object) -> bool:
    held = [value]
    while held:
        v = held.pop()
        if isinstance(v, str) and v.strip():
            return True
        held += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return False


def said(content: object) -> str:
    """A text, or the texts of a list of parts joined; parts without a text (images, say) have none."""
    if content is None or isinstance(content, str):
        return content or ""
    if not isinstance(content, list):
        raise Unreadable
    out = []
    for part in content:
        text = part.get("text") if isinstance(part, dict) else part
        if not isinstance(text, str | None) or isinstance(part, dict) and any(k not in ("text", "type") and lost(k, v) and k not in MEDIA for k, v in part.items()):
            raise Unreadable
        out.append(text or "")
    return "".join(out)


#: Fields of parts that are no text: what they hold is a picture or a sound, or where it lies.
MEDIA = frozenset("image image_url audio input_audio video file".split())


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("ai", "assistant"), ("model", "assistant"))
_PARTS = [{"type": "", "text": ""}]
_many = lambda **x: Mapping(roles=SPEAKERS, **x)
_lead = (("system", "system"),)
_ALPACA = (("instruction", "user"), ("input", "user"), ("output", "assistant"))
#: A sample of each layout, and how it is read. Names of speakers become roles in all but the last, which keeps them.
LAYOUTS: list[tuple[dict, Mapping]] = [
    ({"prompt": "", "response": ""}, Mapping(turns=(("prompt", "user"), ("response", "assistant")))),
    ({"prompt": "", "completion": ""}, Mapping(turns=(("prompt", "user"), ("completion", "assistant")))),
    ({"question": "", "answer": ""}, Mapping(turns=(("question", "user"), ("answer", "assistant")))),
    ({"instruction": "", "output": ""}, Mapping(turns=_ALPACA)),
    ({"instruction": "", "response": ""}, Mapping(turns=(("instruction", "user"), ("response", "assistant")))),
    ({"instruction": "", "context": "", "response": ""}, Mapping(turns=(("instruction", "user"), ("context", "user"), ("response", "assistant")))),
    ({"instruction": "", "input": "", "output": ""}, Mapping(turns=_ALPACA)),
    ({"instruction": "", "input": "", "output": "", "history": []}, Mapping(turns=_ALPACA, pairs="history")),
    ({"instruction": "", "input": "", "output": "", "history": [[""]]}, Mapping(turns=_ALPACA, pairs="history")),
    ({"system": "", "instruction": "", "input": "", "output": "", "history": [[""]]}, Mapping(turns=(*_lead, *_ALPACA), pairs="history")),
    ({"system": "", "instruction": "", "input": "", "output": ""}, Mapping(turns=(*_lead, *_ALPACA))),
    ({"system": "", "instruction": "", "output": ""}, Mapping(turns=(*_lead, *_ALPACA))),
    ({"system_prompt": "", "question": "", "response": ""}, Mapping(turns=(("system_prompt", "system"), ("question", "user"), ("response", "assistant")))),
    ({"question": "", "response": ""}, Mapping(turns=(("question", "user"), ("response", "assistant")))),
    ({"input": "", "output": ""}, Mapping(turns=(("input", "user"), ("output", "assistant")))),
    ({"messages": [{"role": "", "content": ""}]}, _many(many="messages")),
    ({"messages": []}, _many(many="messages")),
    ({"messages": [{"role": "", "text": ""}]}, _many(many="messages", text="text")),
    ({"messages": [{"role": "", "content": _PARTS}]}, _many(many="messages")),
    ({"system": "", "messages": [{"role": "", "content": ""}]}, _many(turns=_lead, many="messages")),
    ({"system": "", "messages": [{"role": "", "content": _PARTS}]}, _many(turns=_lead, many="messages")),
    ({"conversations": [{"from": "", "value": ""}]}, _many(many="conversations", role="from", text="value")),
    ({"system": "", "conversations": [{"from": "", "value": ""}]}, _many(turns=_lead, many="conversations", role="from", text="value")),
    ({"turns": [{"speaker": "", "text": ""}]}, Mapping(many="turns", role="speaker", text="text")),
]


class Layouts:
    """Mappings by the fingerprint of their sample, and for other fingerprints by the paths that they need."""

    def __init__(self, layouts: list[tuple[dict, Mapping]]):
        self.exact = {fingerprint(sample): mapping for sample, mapping in layouts}
        paths = [(field_paths(sample), mapping) for sample, mapping in layouts]
        self.needs = sorted(paths, key=lambda x: (-len(x[0]), sorted(x[0])))
        self.met: dict[str, Mapping | None] = dict(self.exact)

    def of(self, found: str, paths: set[str]) -> Mapping | None:
        if found not in self.met:
            if len(self.met) > 10_000:
                self.met = dict(self.exact)
            self.met[found] = next((m for needs, m in self.needs if needs <= paths), None)
        return self.met[found]


TURNS = "array<struct<role: string, text: string>>"


def canonical_turns(records: DataFrame, layouts: list[tuple[dict, Mapping]] = LAYOUTS) -> DataFrame:
    """(conv_id, record: JSON) -> conv_id, layout (the fingerprint), turns; turns are null where no mapping fits."""
    known = Layouts(layouts)

    def made(batch: pa.RecordBatch) -> tuple[None, list]:
        found, turns = [], []
        for text in values(batch, "record"):
            try:
                value = json.loads(text or "null")
            except (ValueError, RecursionError):  # no JSON, or nested beyond any layout
                value = None
            paths = field_paths(value)
            found.append(hashed(paths))
            mapping = known.of(found[-1], paths) if isinstance(value, dict) else None
            read = mapping.read(value) if mapping else None
            turns.append(None if read is None else [{"role": r, "text": t} for r, t in read])
        return None, [found, turns]

    return batched(records.select(F.col("conv_id").cast("long"), "record"), ["conv_id"], f"layout string, turns {TURNS}", made)


def as_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn -> one JSON record per conversation, each in the layout its shape suggests.

    A user turn and an answer make an instruction record (with a system field, if that leads); other
    conversations whose roles are user and assistant make a list of from/value pairs, the rest messages; those with
    a role that a layout would rename are kept as turns of speakers.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select(F.col("conv_id").cast("long"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    roles = F.transform("rows", lambda r: r["role"])
    text = lambda k: F.element_at("rows", k)["text"]
    spoken = F.forall("rows", lambda r: r["role"].isin("user", "assistant"))
    said = F.transform("rows", lambda r: F.struct(F.when(r["role"] == "user", "human").otherwise("gpt").alias("from"), r["text"].alias("value")))
    messages = F.transform("rows", lambda r: F.struct(r["role"], r["text"].alias("content")))
    plain = F.transform("rows", lambda r: F.struct(r["role"].alias("speaker"), r["text"]))
    renamed = F.exists("rows", lambda r: r["role"].isin([name for name, _ in SPEAKERS]))
    is_ = lambda *names: F.coalesce(roles == F.array(*map(F.lit, names)), F.lit(False))
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(1).alias("instruction"), text(2).alias("output"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text(1).alias("system"), text(2).alias("instruction"), text(3).alias("output"))))
        .when(spoken, F.to_json(F.struct(said.alias("conversations"))))
        .when(renamed, F.to_json(F.struct(plain.alias("turns")))).otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


# --- the template -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """Marks around turns. Control strings inside texts get the escape character after their first character."""

    open_role: str = "<|im_start|>"
    close_role: str = "\n"
    close_turn: str = "<|im_end|>\n"
    learn: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    escape: str = "⁠"

    @cached_property
    def _pattern(self) -> re.Pattern:
        # A control string with any number of escape characters after its first character, so that escaping adds one and unescaping takes one.
        ends: dict[str, list[str]] = {}
        for c in sorted(self.control, key=len, reverse=True):
            ends.setdefault(c[0], []).append(re.escape(c[1:]))
        return re.compile("|".join(f"(?<={re.escape(a)})({re.escape(self.escape)}*)(?={'|'.join(b)})" for a, b in ends.items()))

    @cached_property
    def _begins(self) -> re.Pattern:
        return re.compile("[" + re.escape("".join({c[0] for c in self.control})) + "]")

    def escaped(self, text: str) -> str:
        return self._pattern.sub(lambda m: m[0] + self.escape, text) if self._begins.search(text) else text

    def unescaped(self, text: str) -> str:
        return self._pattern.sub(lambda m: m[0][len(self.escape):], text) if self._begins.search(text) else text

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of it that count for the loss."""
        out, spans, at = [], [], 0
        for role, text in turns:
            # A role stands on one line: its own newlines are written as \n.
            name = self.escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))
            head, body = f"{self.open_role}{name}{self.close_role}", self.escaped(text)
            if role in self.learn:
                spans.append((at + len(head), at + len(head) + len(body)))
            out.append(f"{head}{body}{self.close_turn}")
            at += len(out[-1])
        return "".join(out), spans

    def parse(self, text: str) -> list[tuple[str, str, int]]:
        """(role, text, where the escaped text begins) of each turn."""
        out, at = [], 0
        while at < len(text):
            if not text.startswith(self.open_role, at):
                raise ValueError(f"no turn begins at {at}")
            head = text.index(self.close_role, at)
            end = text.index(self.close_turn, head)
            name = self.unescaped(text[at + len(self.open_role): head])
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name, flags=re.S)
            begin = head + len(self.close_role)
            out.append((role, self.unescaped(text[begin:end]), begin))
            at = end + len(self.close_turn)
        return out


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns) -> conv_id, formatted, loss_spans (begin and end, in code points)."""

    def formatted(batch: pa.RecordBatch) -> tuple[None, list]:
        out = [template.format([(t["role"], t["text"]) for t in row or ()]) for row in values(batch, "turns")]
        return None, [[o[0] for o in out], [[{"begin": a, "end": b} for a, b in o[1]] for o in out]]

    return batched(turns.select("conv_id", "turns"), ["conv_id"], "formatted string, loss_spans array<struct<begin: long, end: long>>", formatted)


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digest columns, from nothing but the formatted text and its loss spans."""

    def digests(batch: pa.RecordBatch) -> tuple[None, list]:
        rows = []
        for text, spans in zip(values(batch, "formatted"), values(batch, "loss_spans"), strict=True):
            turns = template.parse(text)
            loss = "".join(template.unescaped(text[s["begin"]: s["end"]]) for s in spans or ())
            all_said = "".join(f"{r}\n{t}\n" for r, t, _ in turns)
            rows.append((len(turns), hashlib.sha256(all_said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        return None, list(zip(*rows, strict=True)) or [[]] * 5

    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return batched(formatted.select("conv_id", "formatted", "loss_spans"), ["conv_id"], schema, digests)
