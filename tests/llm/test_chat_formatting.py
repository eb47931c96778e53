import hashlib
import random
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chat_formatting as T

PIECES = [*T.CHAT.controls, "\\", "<", "[", "/", "s>", "INST]", "\n", " ", "é", "<<", ">>", "SYS", "a"]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[/ROLE]", "</s>\\"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=6))
def test_any_text_is_read_back(turns):
    text = "".join(s for role, said in turns for s, _ in T.CHAT.segments(role, said))
    assert list(T.CHAT.parse(text)) == turns
    for role, said in turns:
        safe = T.CHAT.segments(role, said)[1][0]
        assert not any(c in safe for c in T.CHAT.controls) and T.plain(safe) == said


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2], r[3]))
    out = []
    for _, own in groupby(rows, key):
        own = list(own)
        state, broken = T.CHAT.start, None
        for i, (_, _, role, _) in enumerate(own):
            state = T.CHAT.order.get(state, {}).get(role, "")
            broken = i if state == "" and broken is None else broken
        said = "".join(x for _, _, r, x in own if r == "assistant")
        size = sum(len(s) for _, _, r, x in own for s, _ in T.CHAT.segments(r, x))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((own[0][0], len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(said), sha(said), size, state in T.CHAT.ends, broken))
    return sorted(out, key=str)


def test_conversations_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[t % 2], "".join(rng.choice(PIECES) for _ in range(9))) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, "system", "be"), (100, 1, "user", None), (100, 2, "assistant", ""), (101, 0, None, None), (102, None, "user", "x"), (102, 0, "assistant", "y" * 5000), (None, 1, "user", "a"), (None, 0, "tool", "b")]
    rows += [(103, 5, "user", "same")] * 3 + [(104, 1, "assistant", "first"), (104, 0, "user", "later in the table")]
    rows += [(50, t, ("user", "assistant")[t % 2], f"hot {t} </s>") for t in range(100, 700)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, piece int").repartition(3)
    for size in (1 << 20, 200):
        monkeypatch.setattr(T, "BLOCK", size)
        formatted = T.blocks(turns)
        assert sorted(map(tuple, T.read_back(formatted.cache()).collect()), key=str) == brute(rows)
    assert formatted.where("conv_id = 50").count() > 20
    assert formatted.groupBy("conv_id", "whole").count().where("whole and count > 1").count() == 0
    assert T.read_back(T.blocks(turns.limit(0))).count() == 0


def test_a_long_conversation_is_dealt_over_tasks(spark):
    turns = spark.range(4000).selectExpr("cast(1 as bigint) as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', 50) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = T.blocks(turns).groupBy("part").agg({"n_turns": "sum"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(p[1] for p in parts) < 2000
    got = T.read_back(T.blocks(turns)).first()
    assert (got.n_turns, got.valid, got.loss_chars) == (4000, True, 2000 * 250)


@pytest.mark.parametrize("marks", [("<a>", "", "[/x]"), ("<a>", "\\n", "[/x]"), ("<a>", "||", "[/x]"), ("<a>", "<a>b", "[/x]")])
def test_a_template_that_could_not_be_read_back_is_refused(marks):
    with pytest.raises(ValueError):
        T.Template({"user": T.Mark(marks[0], marks[1])}, T.Mark("[x]", "</s>"), marks[2], {}, "start", frozenset())
