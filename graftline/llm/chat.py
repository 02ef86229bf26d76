"""Chat formatting with typed content parts and a loss mask.

A turn's content is a list of typed parts.  A visitor flattens them: text is
escaped, and an image, audio clip or document becomes a placeholder in its order,
with its reference and expanded token count recorded as an attachment.

Every control string has a ``<`` or ``[`` that no backslash follows.  Escaping puts
one backslash after each ``<`` and ``[`` of a text and unescaping takes it away, so
no text can form a control string and every text comes back as it was.

A conversation's text is its formatted turns one after the other.  It is written in
rows of a fixed number of characters, whose borders have nothing to do with turns;
reading it back finds the turns by the template's marks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stash import stash
from ..operators.unions import union_all
from . import text as tx

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,duration_ms:long,pages:int>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,position:long,tokens:long>>"

#: Role markers: what stands before and after the text of a turn.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}


def escape(text: str) -> str:
    return text.replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


@dataclass
class Visitor:
    """Flattens the parts of one turn."""

    #: Side of a square image patch, milliseconds of an audio token, tokens of a document page.
    patch: int = 28
    audio_ms: int = 40
    page_tokens: int = 512
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _attach(self, kind: str, part: dict, tokens: int, mark: str | None = None) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": self.length, "tokens": tokens})
        self._add(f"<|{mark or kind}|>")

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda n: max(1, -(-(n or 0) // self.patch))
        self._attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, -(-(part.get("duration_ms") or 0) // self.audio_ms)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        """A kind without a visitor: a placeholder of no tokens, its kind and reference kept."""
        self._attach(str(part.get("kind")), part, 0, "attachment")


def placeholder(kind: str) -> str:
    """What stands in the text for an attachment of a kind."""
    return f"<|{kind if kind in ('image', 'audio', 'document') else 'attachment'}|>"


def marks(role: str | None) -> tuple[str, str]:
    """The markers of a role; roles without their own are named in the marker."""
    role = role or ""
    return MARKS.get(role) or (f"<<ROLE>>{escape(role)}<</ROLE>>\n", "\n<</TURN>>")


def text_part(col: str = "text") -> F.Column:
    """A plain text column as one text part."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(col), F.lit("")).alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("long").alias("duration_ms"), null("int").alias("pages"))).cast(PARTS)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end, attachments, expanded_tokens), one row for each turn.

    A conversation's text is its turns' ``formatted`` in order of turn.  The loss
    mask of a turn is [loss_start, loss_end) in code points: an assistant's content,
    empty for other roles.  Null content is empty; a null role is an unnamed one.
    A part of an unknown kind is a placeholder of no tokens, with its kind and reference recorded.
    Turns are formatted one by one, so a conversation of any length needs no more memory.
    Other columns of ``turns``, whatever their names, are not read; empty in, empty out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple] = []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v = Visitor()
                before, after = marks(role)
                v._add(before)
                for part in parts or []:
                    v.visit(part or {})
                start, end = (len(before), v.length) if role == "assistant" else (0, 0)
                v._add(after)
                done.append(("".join(v.out), start, end, v.attachments, sum(a["tokens"] for a in v.attachments)))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True) if done else [()] * 5, [pa.string(), pa.int64(), pa.int64(), _ATTACHED, pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    rows = tx.bounded(turns).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(parts_col).alias("parts"))
    return rows.mapInArrow(run, f"conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments {ATTACHMENTS}, expanded_tokens long")


#: Characters of a conversation's text in one row.
CHUNK_CHARS = 1 << 20
TEXTS = f"conv_id long, chunk long, whole boolean, last boolean, text string, loss array<struct<start:long,end:long>>, attachments {ATTACHMENTS}"
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class _Writer:
    """One conversation's text, cut into chunks, with the spans of its loss mask and its attachments."""

    def __init__(self, conv: int | None, size: int):
        self.conv, self.size, self.base, self.number, self.held = conv, size, 0, 0, 0
        self.parts: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def add(self, text: str, a: int, b: int, attachments: list[dict]) -> Iterator[tuple]:
        self.attachments += [x | {"position": x["position"] + self.base + self.held} for x in attachments]
        if b > a:
            self.spans.append((self.base + self.held + a, self.base + self.held + b))
        self.parts.append(text)
        self.held += len(text)
        if self.held > self.size:
            whole = "".join(self.parts)
            cut = (self.held - 1) // self.size * self.size  # at least one character stays for the last row
            for k in range(0, cut, self.size):
                yield self.row(whole[k : k + self.size], False)
            self.parts, self.held = [whole[cut:]], self.held - cut

    def row(self, text: str, last: bool) -> tuple:
        end = self.base + len(text)
        loss = [{"start": max(a, self.base), "end": min(b, end)} for a, b in self.spans if a < end]
        self.spans = [x for x in self.spans if x[1] > end]
        attachments = [x for x in self.attachments if x["position"] < end]
        self.attachments = self.attachments[len(attachments) :]
        out = (self.conv, self.number, last and not self.number, last, text, loss, attachments)
        self.base, self.number = end, self.number + 1
        return out

    def close(self) -> tuple:
        return self.row("".join(self.parts), True)


def conversations(formatted: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(conv_id, chunk, whole, last, text, loss, attachments): each conversation's text in rows of ``chunk_chars`` characters.

    Turns follow in order of turn; those of one number by their formatted text, null
    numbers first.  Turns without a conversation are one.  ``whole`` marks rows that
    hold a whole conversation; ``loss`` has the loss mask's spans in code points of
    the conversation, and ``attachments`` are those whose placeholder begins in the row, with its place
    in the conversation.  A task streams its turns and holds one row's text at a time.
    """
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), _LOSS, _ATTACHED]
    names = ["conv_id", "chunk", "whole", "last", "text", "loss", "attachments"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Writer | None = None
        for batch in batches:
            done: list[tuple] = []
            for conv, text, a, b, attachments in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.close())
                    now = _Writer(conv, chunk_chars)
                for row in now.add(text, a, b, attachments):
                    done.append(row)
                    if len(done) >= 16 and len(row[4]) == chunk_chars:
                        yield batch_of(done)
                        done = []
            yield batch_of(done)
        if now is not None:
            yield batch_of([now.close()])

    rows = formatted.select("conv_id", "formatted", "loss_start", "loss_end", "attachments", "turn")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, TEXTS)


def next_turn(text: str, at: int, resume: int = 0) -> tuple[str, int, int, int] | None:
    """(role, content start, content end, end) of the turn that begins at a place, or None if the text ends within it.

    The end mark is looked for from ``resume`` on.
    """
    if text.startswith("<<ROLE>>", at):
        close = text.find("<</ROLE>>\n", at)
        if close < 0:
            return None
        role, begin, after = unescape(text[at + 8 : close]), close + 10, "\n<</TURN>>"
    else:
        for role, (before, after) in MARKS.items():
            if text.startswith(before, at):
                begin = at + len(before)
                break
        else:
            if any(m.startswith(text[at : at + 8]) for m in ("<<ROLE>>", *(b for b, _ in MARKS.values()))):
                return None
            raise ValueError("not a formatted conversation")
    end = text.find(after, max(begin, resume))
    return None if end < 0 else (role, begin, end, end + len(after))


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders stay in the text."""
    found = next_turn(formatted, 0)
    if found is None or found[3] != len(formatted):
        raise ValueError("not a formatted turn")
    return found[0], unescape(formatted[found[1] : found[2]])


class _Reader:
    """Reads one conversation's chunks in order: turns by their marks, the masked text by the loss spans."""

    def __init__(self, conv: int | None):
        self.conv, self.text, self.base, self.resume = conv, "", 0, 0
        self.turns, self.loss_chars, self.attached, self.tokens = 0, 0, 0, 0
        self.marks: list[tuple[int, str]] = []
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()
        self.spans: list[list[int]] = []

    def add(self, text: str, spans: list[dict], attachments: list[dict]) -> None:
        self.attached += len(attachments)
        self.tokens += sum(x["tokens"] for x in attachments)
        self.marks += [(x["position"], placeholder(x["kind"])) for x in attachments]
        for s in spans:
            if self.spans and self.spans[-1][1] == s["start"]:
                self.spans[-1][1] = s["end"]  # a span that a row's end has cut
            else:
                self.spans.append([s["start"], s["end"]])
        self.text += text
        at = 0
        while at < len(self.text) and (found := next_turn(self.text, at, self.resume)):
            role, a, b, end = found
            self.turns += 1
            while self.marks and self.marks[0][0] < self.base + end:
                place, mark = self.marks.pop(0)
                if not self.text.startswith(mark, place - self.base):
                    raise ValueError("an attachment without its placeholder")
            self.said.update(f"{role}\n{unescape(self.text[a:b])}\n".encode())
            while self.spans and self.spans[0][0] < self.base + end:
                x, y = self.spans.pop(0)
                masked = unescape(self.text[x - self.base : y - self.base])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())
            at, self.resume = end, 0
        self.base, self.text = self.base + at, self.text[at:]
        self.resume = max(0, len(self.text) - 16)  # no mark is longer

    def close(self) -> tuple:
        if self.text:
            raise ValueError("a conversation ends within a turn")
        return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.base, self.attached, self.tokens


def digests(texts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens), parsed from conversations' texts.

    Attachments are those of the stored conversation, each held against the placeholder at its place.

    ``texts`` are rows of ``conversations``.  Rows that hold a whole conversation are
    read where they are; only chunks of longer ones are shuffled, and stream through
    one task in order, which holds two hash states and one turn.  Empty in, empty out.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None
        for batch in batches:
            done = []
            for conv, last, text, loss, attachments in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                now = now or _Reader(conv)
                now.add(text, loss, attachments)
                if last:
                    done.append(now.close())
                    now = None
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True) if done else [()] * 8, kinds, strict=True)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    needed = ["conv_id", "last", "text", "loss", "attachments"]
    parts = texts.filter("not whole").select(*needed, "chunk").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return union_all([texts.filter("whole").select(needed).mapInArrow(run, schema), parts.select(needed).mapInArrow(run, schema)])


def format_and_read_back(turns: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Format, write the conversations' texts to the shared folder, read them back and digest."""
    return digests(stash(conversations(format_turns(turns), chunk_chars), "chat"))
