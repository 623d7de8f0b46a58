"""Chat formatting from event logs.

A conversation is a log of events. They are dealt by conversation and sorted
by sequence, and folded as a stream: a message opens, deltas append to it, an
edit replaces its text, a regeneration empties it, a deletion removes it. Final messages
are rendered with turn markers; control strings inside texts are escaped so
that they can be read back. Assistant texts are under the loss mask.

The output of a conversation is a row of pieces, so no row grows with it. The
fold holds one message's text and the open conversation's unfinished events
at a time, never the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, fields, map_rows

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The control strings of common chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
#: A piece holds this many characters at most, so long messages take several.
PIECE = 1 << 20


def escape(text: str) -> str:
    """One more backslash after the first character of every control string."""
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """As escape(), and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text begins and ends."""
    body = escape(text)
    head = f"{OPEN}{escape_role(role)}\n"
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def fold(events: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """(role, text) of the final messages, in the order in which they opened.

    events: (kind, message, role, text) by sequence. open starts a message;
    delta, edit, regenerate and delete refer to one by its name (null: the
    last opened). Events for an unknown message are ignored. Messages are
    given out at close, or at the end; what refers to a closed message is
    ignored.
    """
    live: dict[object, list] = {}
    last = None
    for kind, message, role, text in events:
        if kind == "open":
            last = message
            live[message] = [role or "", [text or ""], False]
            continue
        key = last if message is None else message
        if key not in live:
            continue
        m = live[key]
        if kind == "delta":
            m[1].append(text or "")
        elif kind == "edit":
            m[1] = [text or ""]
        elif kind == "regenerate":
            m[1] = []
        elif kind == "delete":
            del live[key]
        elif kind == "close":
            m[2] = True
        while live and next(iter(live.values()))[2]:
            m = live.pop(next(iter(live)))
            yield m[0], "".join(m[1])
    for m in live.values():
        yield m[0], "".join(m[1])


def format_events(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted conversations as pieces.

    events: conv_id, seq, kind, message, role, text. Returns conv_id, piece,
    text, loss_from and loss_to (code points in the piece under the loss
    mask, equal if none); a conversation's pieces by number, joined, are its
    output. Order within equal seq is by kind, role and text. A null conv_id is a
    conversation of its own.
    """
    names = ("seq", "kind", "message", "role", "text")
    dealt = events.select("conv_id", *names).repartition("conv_id").sortWithinPartitions("conv_id", *names).select("conv_id", *names[1:])
    conv = events.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for (conv_id,), rows in by_key(batches, 1):
            at = 0
            for role, text in fold((kind, message, role, text) for _, kind, message, role, text in rows):
                out, a, b = render(role, text)
                lossy = role in loss_roles
                for i in range(0, len(out), PIECE):
                    part = out[i : i + PIECE]
                    lo, hi = (max(a - i, 0), min(b - i, len(part))) if lossy else (0, 0)
                    yield conv_id, at, part, min(lo, len(part)), max(hi, min(lo, len(part)))
                    at += 1

    return map_rows(dealt, run, fields(("conv_id", conv), ("piece", "bigint"), ("text", "string"), ("loss_from", "int"), ("loss_to", "int")), 512)


def read_back(pieces: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, masked text) of each turn in a conversation's pieces; all unescaped."""
    text, masked, end = [], [], ""
    for part, lo, hi in pieces:
        text.append(part)
        masked.append(part[lo:hi])
        end = (end + part)[-len(CLOSE) - 1 :]
        if end == f"{CLOSE}\n":
            whole = "".join(text)
            role, _, body = whole[len(OPEN) : -len(CLOSE) - 1].partition("\n")
            yield unescape_role(role), unescape(body), unescape("".join(masked))
            text, masked, end = [], [], ""


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its pieces, which must be in order within their partitions, as format_events leaves them."""
    conv = formatted.schema["conv_id"].dataType.simpleString()
    schema = fields(("conv_id", conv), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint"))

    def run(batches):
        for (conv_id,), rows in by_key(batches, 1):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def counted(rows=rows):
                nonlocal size
                for _, _, part, lo, hi in rows:
                    size += len(part)
                    yield part, lo, hi

            for role, text, masked in read_back(counted()):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                n, chars = n + 1, chars + len(masked)
            yield conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size

    return map_rows(formatted, run, schema)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log that a chat service would have kept, and that folds to these turns.

    By a hash, a turn is streamed in two halves; or streamed wrongly,
    regenerated and streamed again; or begun and then edited to its text; or
    preceded by a draft that is deleted. seq is by turn, role and text, and
    then by step.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    none = F.lit(None).cast("string")
    message = F.col("row_").cast("string")
    draft = F.concat(F.lit("draft "), message)

    def log(*events):
        return F.array(*[F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), part.alias("part"), name.alias("message")) for i, (kind, part, name) in enumerate(events)])

    streamed = [("open", none, message), ("delta", first, message), ("delta", second, message), ("close", none, message)]
    logs = (
        log(*streamed),
        log(streamed[0], ("delta", F.reverse(first), message), ("regenerate", none, message), *streamed[1:]),
        log(streamed[0], ("delta", second, message), ("edit", text, message), streamed[3]),
        log(("open", none, draft), ("delta", first, draft), ("delete", none, draft), *streamed),
    )
    which = F.pmod(F.xxhash64("conv_id", "turn", text), F.lit(len(logs)))
    steps = F.when(which == 0, logs[0]).when(which == 1, logs[1]).when(which == 2, logs[2]).otherwise(logs[3])
    order = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("text"), F.col("row_").alias("row"))
    each = turns.select("conv_id", "turn", "role", "text").withColumn("row_", F.monotonically_increasing_id())
    each = each.select("conv_id", order.alias("o"), "role", F.explode(steps).alias("s"))
    return each.select("conv_id", F.struct("o", F.col("s.step").alias("step")).alias("seq"), F.col("s.kind").alias("kind"), F.col("s.message").alias("message"), "role", F.col("s.part").alias("text"))


def probe_conversation(spark) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
