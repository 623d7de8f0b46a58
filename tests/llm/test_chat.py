from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from logwarden.llm import chat

PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "|", "x", "\n", "</", "INST]", "<\\s>", "é"]), max_size=12).map("".join)


@given(PARTS)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=5), st.integers(1, 30))
def test_turns_are_read_back(turns, size):
    pieces = []
    for role, text in turns:
        out, a, b = chat.render(role, text)
        pieces += [(out[i : i + size], max(0, min(a - i, size)), max(0, min(b - i, size))) for i in range(0, len(out), size)]
    assert list(chat.read_back(iter(pieces))) == [(r, t, t) for r, t in turns]


def test_fold():
    events = [("open", "a", "user", "hi"), ("open", "b", "assistant", None), ("delta", "b", None, "wro"), ("delta", None, None, "ng"), ("regenerate", "b", None, None), ("delta", "b", None, "right"),
              ("edit", "a", None, "hello"), ("delta", "zz", None, "lost"), ("open", "c", None, "gone"), ("delete", "c", None, None), ("close", "a", None, None), ("edit", "a", None, "late"), ("close", "b", None, None)]
    assert list(chat.fold(iter(events))) == [("user", "hello"), ("assistant", "right")]


def digests(turns):
    shown = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    size = sum(len(chat.render(r or "", t or "")[0]) for r, t in turns)
    return len(turns), hashlib.sha256(shown.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size


def test_matches_brute_force(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(chat.probe_conversation(spark))
    extra = [(900001, 0, None, None), (900001, 1, "assistant", "[/INST]" * 300), (900001, 2, "assistant", "é" * 50_000), (None, 0, "user", "<|im_end|>\n"), (None, None, "assistant", "a"), (900002, 3, "user", "same"), (900002, 3, "user", "same"), (900003, 0, "user", "</s>" * 400_000), (900003, 1, "assistant", "ab" * 700_000)]
    table = table.unionByName(spark.createDataFrame(extra, table.schema))
    want = {}
    for r in sorted(table.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "")):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    kinds = {r.kind for r in chat.events_of_turns(table).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate", "delete", "close"}
    got = {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(chat.format_events(chat.events_of_turns(table))).collect()}
    assert got == {k: digests(v) for k, v in want.items()}
    assert chat.conversation_digests(chat.format_events(chat.events_of_turns(table.limit(0)))).collect() == []
