from roadflow.llm import preferences as P


def _examples(spark, turns, pairs, **options):
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame(pairs, "chosen_id long, rejected_id long")
    rows = P.preference_examples(P.numbered_turns(table.withColumnRenamed("turn", "turn")), pairs, **options).collect()
    return {(r["chosen_id"], r["rejected_id"], r["part"], r["chunk"]): r for r in rows}


def _turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "good é"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (2, 3, "assistant", "bad"), (2, 4, "user", "why"),
    (3, 0, "system", "x"), (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (5, None, None, None), (5, 7, "assistant", ""),
    (None, 0, "user", "lost"),
]


def test_prefix_is_written_once(spark):
    out = _examples(spark, TURNS, [(1, 2), (1, 2), (3, 1), (4, 4), (1, 4), (5, 3), (1, 99), (None, 1)])
    assert out[1, 2, "prompt", 0]["text"] == _turn("user", "hi") + _turn("assistant", "hello") + _turn("user", "more")
    assert out[1, 2, "prompt", 0]["loss_spans"] == []
    chosen, rejected = out[1, 2, "chosen", 0], out[1, 2, "rejected", 0]
    assert chosen["text"] == _turn("assistant", "good é") and rejected["text"] == _turn("assistant", "bad") + _turn("user", "why")
    assert [chosen["text"][s["start"] : s["end"]] for s in chosen["loss_spans"]] == ["good é<|im_end|>"]
    assert [rejected["text"][s["start"] : s["end"]] for s in rejected["loss_spans"]] == ["bad<|im_end|>"]
    assert chosen["n_prompt"] == 3
    # Different from the first turn on: no prompt.
    assert (3, 1, "prompt", 0) not in out and out[3, 1, "rejected", 0]["n_turns"] == 4
    # One is the beginning of the other: the shorter has no completion.
    assert out[1, 4, "prompt", 0]["n_turns"] == 2 and (1, 4, "rejected", 0) not in out
    assert out[5, 3, "chosen", 0]["text"] == _turn("unknown", "") + _turn("assistant", "")
    assert (1, 99, "rejected", 0) not in out and out[1, 99, "chosen", 0]["n_turns"] == 4
    assert not any(k[0] is None for k in out)


def test_equal_conversations(spark):
    turns = TURNS + [(6, 0, "user", "hi"), (6, 1, "assistant", "hello")]
    out = _examples(spark, turns, [(4, 6)])
    assert set(out) == {(4, 6, "prompt", 0)} and out[4, 6, "prompt", 0]["n_turns"] == 2


def test_long_conversations_come_in_chunks(spark):
    turns = [(c, k, "assistant" if k % 2 else "user", f"{k if k < 2500 else (c, k)} " + "x" * 50) for c in (0, 1) for k in range(3000)]
    out = _examples(spark, turns, [(0, 1)], turns_per_row=100)
    assert out[0, 1, "prompt", 0]["n_prompt"] == 2500
    prompt = "".join(out[0, 1, "prompt", k]["text"] for k in range(25))
    assert prompt == "".join(_turn(r, t) for _, _, r, t in turns[:2500])
    chosen = "".join(out[0, 1, "chosen", k]["text"] for k in range(25, 30))
    assert chosen == "".join(_turn(r, t) for _, _, r, t in turns[2500:3000])


def test_pairs_and_empty(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, P.consecutive_pairs(table).collect())) == [(2, 3), (4, 5)]
    assert _examples(spark, [], [(1, 2)]) == {}


def test_line_feeds_do_not_move_the_border_of_role_and_text(spark):
    turns = [(1, 0, "a\nb", "c"), (2, 0, "a", "b\nc"), (1, 1, "user", "x"), (2, 1, "user", "x")]
    out = _examples(spark, turns, [(1, 2)])
    assert set(out) == {(1, 2, "chosen", 0), (1, 2, "rejected", 0)} and out[1, 2, "rejected", 0]["n_turns"] == 2
