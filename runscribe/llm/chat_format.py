"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document).  A visitor writes text with its control
strings escaped, replaces every other part by an ordered placeholder, and records the attachment's reference
and the number of tokens that its placeholder expands to.  Text parts that stand side by side are escaped as one
text, so no control string can be put together from several.  Turns are marked by ``<|im_start|>role`` and
``<|im_end|>``; assistant content is under the loss mask, kept as spans of the formatted text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)
KINDS = ("text", "image", "audio", "document")
FORMATTED = "formatted string, loss_spans array<struct<start:int,end:int>>, attachments array<struct<ordinal:int,kind:string,ref:string,start:int,tokens:long>>"


def escape(text: str) -> str:
    """No ``<|`` is left, and :func:`unescape` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def amount(value: float | None) -> float:
    """A size as it counts: missing, not finite or negative is 0, and none is over 10**9."""
    return min(max(0.0, value), 1e9) if value is not None and math.isfinite(value) else 0.0


def joined_texts(parts: list[dict | None]) -> Iterator[dict]:
    """The parts in order, with text parts that stand side by side (null parts between them don't count) as one."""
    texts: list[str] = []
    for part in parts:
        if part is None:
            continue
        if (part.get("type") or "text") == "text":
            texts.append(part.get("text") or "")
            continue
        if texts:
            yield {"type": "text", "text": "".join(texts)}
            texts = []
        yield part
    if texts:
        yield {"type": "text", "text": "".join(texts)}


class PartVisitor:
    """Flattens parts in order; ``patch`` pixels and ``audio_rate`` and ``page_tokens`` set how far placeholders expand."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []
        self.spans: list[dict] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit(self, part: dict) -> None:
        """Anything whose type isn't known is an attachment of kind ``other``; no type at all is text."""
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}" if kind in KINDS else "visit_other")(part)

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(amount(part.get(k)) / self.patch) for k in ("width", "height"))
        self._place("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, max(1, math.ceil(amount(part.get("seconds")) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, max(1, int(amount(part.get("pages"))) * self.page_tokens))

    def visit_other(self, part: dict) -> None:
        self._place("other", part, 1)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        ordinal = len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "kind": kind, "ref": part.get("ref"), "start": self.length, "tokens": tokens})
        self.write(f"<|{kind}_{ordinal}|>")

    def turn(self, role: str | None, parts: list[dict]) -> None:
        self.write(f"{START}{escape_role(role or '')}\n")
        begin = self.length
        for part in joined_texts(parts):
            self.visit(part)
        if role == "assistant" and self.length > begin:
            self.spans.append({"start": begin, "end": self.length})
        self.write(END)


def format_conversations(turns: DataFrame, **expansion) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments: one row a conversation.

    ``turns``: conv_id, turn, role and either text or ``parts`` (array of PART).  Turns stand by turn number,
    nulls first, ties by role and content; repeated rows are repeated turns.  Null text or parts are empty; a
    null role is an empty role; a null conv_id is one conversation; spans are in code points.  Placeholders
    can't be written by texts, whose ``<|`` is escaped.  A part of an unknown type is an attachment of kind
    ``other`` with one token; sizes that are missing, negative or not finite count as 0.  A conversation is one row of the result, so its turns
    meet in one task; conversations are dealt by conv_id.
    """
    if "parts" in turns.columns:
        content = F.transform("parts", lambda p: F.struct(*[p[f.name].cast(f.dataType).alias(f.name) for f in PART.fields]))
    else:
        content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]))
    grouped = (
        turns.select("conv_id", F.struct("turn", "role", content.alias("parts")).alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for turns_of in batch["turns"]:
                visitor = PartVisitor(**expansion)
                for t in turns_of:
                    visitor.turn(t["role"], list(t["parts"]) if t["parts"] is not None else [])
                rows.append(("".join(visitor.out), visitor.spans, visitor.attachments))
            made = pd.DataFrame(rows, columns=["formatted", "loss_spans", "attachments"], dtype=object)
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), made], axis=1)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return grouped.mapInPandas(run, f"conv_id {kind}, {FORMATTED}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, unescaped; placeholders stay as they stand in the text."""
    out = []
    for block in formatted.split(START)[1:]:
        role, _, rest = block.partition("\n")
        out.append((unescape(role), unescape(rest.removesuffix(END))))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text itself holds: turns by its marks, and what lies under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["formatted"], batch["loss_spans"], strict=True):
                turns = parse(text)
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            made = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), made], axis=1)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
