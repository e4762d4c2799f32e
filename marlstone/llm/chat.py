"""Chat formatting of typed content parts, with escapes that can be undone and a loss mask."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import checkpointed, text_slices

# The marks of the template.
OPEN = "### "
AFTER_ROLE = ":\n"
CLOSE = "\n</turn>\n"
#: Written before each control string in a text; it is doubled itself.
ESCAPE = "\\"
CONTROLS = (ESCAPE, "### ", "</turn>", "<|", "|>")
#: Code points from which on a string of turns ends; a longer turn is a string of its own.
CHUNK = 64_000
#: Turns that a task holds as Python objects at once.
SLICE = 256

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())])
#: Tokens that one unit of an attachment expands to: an image's tile, a second of audio, a page of a document.
EXPANSION = {"image": 256, "audio": 25, "document": 600}


def escape(text: str) -> str:
    """Put ESCAPE before every control string; longer ones that overlap are broken by it."""
    for c in CONTROLS:
        text = text.replace(c, ESCAPE + c)
    return text


def unescape(text: str) -> str:
    """The text whose :func:`escape` this is."""
    for c in reversed(CONTROLS):
        text = text.replace(ESCAPE + c, c)
    return text


@dataclass
class Visitor:
    """Flattens content parts in order; one method per part type.

    Text is escaped. Image, audio and document parts become ordered placeholders ``<|image:0|>``, and their references
    and expanded token counts are recorded; ``first`` is the place of the first one. Parts of another or no type count
    as text; null text and null parts are empty.
    """

    first: int = 0
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        getattr(self, f"visit_{part['type']}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def _attach(self, part: dict) -> None:
        place = self.first + len(self.attachments)
        self.out.append(f"<|{part['type']}:{place}|>")
        self.attachments.append({"place": place, "type": part["type"], "ref": part["ref"] or "", "tokens": EXPANSION[part["type"]] * max(1, part["units"] or 1)})

    visit_image = visit_audio = visit_document = _attach


ATTACHMENT = T.StructType([T.StructField("place", T.LongType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())])
SPAN = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])


def text_part(text: Column) -> Column:
    """The content of a plain message: one text part."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), F.lit(None).cast("long").alias("units")))


def attachment_part(kind: Column, ref: Column, units: Column) -> Column:
    """One part that stands for an attachment."""
    return F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), units.cast("long").alias("units"))


def format_turn(role: str | None, content: list | None, trained: frozenset[str], first: int = 0) -> dict:
    """One turn in the template, attachments numbered from ``first``.

    loss_from, loss_to: the code points of the segment that are trained on. A role stands as in a JSON string, so that
    it holds no line break; a null role is empty, null content has no parts.
    """
    v = Visitor(first)
    for part in () if content is None else content:
        v.visit(part)
    body = "".join(v.out)
    head = OPEN + escape(json.dumps(role or "", ensure_ascii=False)[1:-1]) + AFTER_ROLE
    at = len(head)
    return {"segment": head + body + CLOSE, "loss_from": at, "loss_to": at + len(body) if role in trained else at, "attachments": v.attachments}


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, flattened text) of the turns in a formatted conversation, read back from the output alone.

    Unescaped marks stand only where the template put them: in a text each is preceded by ESCAPE.
    """
    at = 0
    while at < len(formatted):
        end = formatted.index(CLOSE, at)
        head, _, body = formatted[at + len(OPEN) : end].partition(AFTER_ROLE)
        yield json.loads(f'"{unescape(head)}"'), unescape(body)
        at = end + len(CLOSE)


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", trained: frozenset[str] = frozenset({"assistant"}), chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, formatted, loss, attachments): the conversations as strings of some ``chunk`` code points, in order.

    ``loss`` has [from, to) in code points of the string; attachments are numbered over the conversation. Turns are in
    order of their number, one without a number first, ties by role and then by a hash of the content; repeated rows
    are turns of their own. Rows without a conversation id are one conversation. Other columns are not read. Messages
    are sorted over ranges, so that a conversation of any size is spread over tasks and none is held whole.
    """
    kinds = list(EXPANSION)
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(content_col).alias("content"))
    attached = F.coalesce(F.size(F.filter("content", lambda p: p["type"].isin(kinds))), F.lit(0))
    m = m.withColumn("attached", F.greatest(attached, F.lit(0))).withColumn("tie", F.xxhash64("content"))
    order = ["conv_id", "turn", "role", "tie", F.xxhash64(F.monotonically_increasing_id())]  # the last cuts even equal rows
    ranges = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = m.repartitionByRange(ranges, *order).sortWithinPartitions("conv_id", "turn", "role", "tie").withColumn("range", F.spark_partition_id())
    ranged = checkpointed(ranged.drop("tie"))
    # Conversations that go on from one range to the next: at most one for each range.
    counts = ranged.groupBy("conv_id", "range").agg(F.sum("attached").alias("n"))
    going = counts.groupBy("conv_id").agg(F.count("*").alias("ranges")).where("ranges > 1").select(F.col("conv_id").alias("of"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")
    firsts = counts.join(going, F.col("conv_id").eqNullSafe(F.col("of"))).select("of", F.col("range").alias("of_range"), before.alias("first"))
    rows = ranged.join(F.broadcast(firsts), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")), "left")
    rows = rows.select("conv_id", "role", "content", "range", F.coalesce("first", F.lit(0)).alias("first"))

    def join(batches):
        key, n, made = None, 0, 0
        parts, loss, files, at = [], [], [], 0

        def done():
            nonlocal parts, loss, files, at, made
            row = {"conv_id": key[0], "chunk": (where << 32) + made, "formatted": "".join(parts), "loss": loss, "attachments": files}
            parts, loss, files, at, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                for r in b.to_pylist():
                    if key != (r["conv_id"],):
                        if parts:
                            yield done()
                        key, n = (r["conv_id"],), r["first"]
                    where = r["range"]
                    turn = format_turn(r["role"], r["content"], trained, n)
                    if turn["loss_to"] > turn["loss_from"]:
                        loss.append({"from": at + turn["loss_from"], "to": at + turn["loss_to"]})
                    files += turn["attachments"]
                    n += len(turn["attachments"])
                    parts.append(turn["segment"])
                    at += len(turn["segment"])
                    if at >= chunk:
                        yield done()
        if parts:
            yield done()

    out = T.StructType([T.StructField("conv_id", m.schema["conv_id"].dataType), T.StructField("chunk", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(SPAN)), T.StructField("attachments", T.ArrayType(ATTACHMENT))])
    schema = to_arrow_schema(out)
    return rows.mapInArrow(join, out)


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted strings: counts and SHA-256 of the turns and of the loss text.

    The strings of a conversation pass in order through running hashes; only some of them are held at a time. Of the
    attachments there are their number, the tokens they expand to, and the SHA-256 of a line ``place type ref`` for each.
    """
    keys = ["conv_id"]
    rows = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk")

    def fold(batches):
        key, state = None, None

        def done():
            n, turns, loss, chars, total, files, tokens, refs = state
            return {"conv_id": key[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total, "n_attachments": files, "expanded_tokens": tokens, "attachments_sha256": refs.hexdigest()}

        for b in batches:
            got = []
            for r in (r for part in text_slices(b, 2) for r in part.to_pylist()):
                if key != (r["conv_id"],):
                    if key is not None:
                        got.append(done())
                    key, state = (r["conv_id"],), [0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, hashlib.sha256()]
                for role, text in read_turns(r["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in r["loss"]:
                    text = unescape(r["formatted"][span["from"] : span["to"]])
                    state[2].update(text.encode())
                    state[3] += len(text)
                state[4] += len(r["formatted"])
                state[5] += len(r["attachments"])
                state[6] += sum(a["tokens"] for a in r["attachments"])
                state[7].update("".join(f"{a['place']} {a['type']} {a['ref']}\n" for a in r["attachments"]).encode())
            yield pa.RecordBatch.from_pylist(got, schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    out = T.StructType([T.StructField("conv_id", chunks.schema["conv_id"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_attachments", T.LongType()), T.StructField("expanded_tokens", T.LongType()), T.StructField("attachments_sha256", T.StringType())])
    schema = to_arrow_schema(out)
    return rows.mapInArrow(fold, out)
