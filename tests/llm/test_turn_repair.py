import hashlib
import sys
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadflow.llm import turn_repair as R

sys.setrecursionlimit(20_000)
SPACES = " \t\n\x0b\f\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def _fault(row, seen):
    bare = row[1].rstrip(SPACES)
    return "blank" if not bare else "duplicate" if row in seen else "" if bare[-1] in ".!?" else "truncated"


def _cheapest(rows):
    """(cost, audit, lines) by trying every edit everywhere."""
    seen, judged = set(), []
    for row in rows:
        judged.append((*row, _fault(row, seen)))
        seen.add(row)
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(k, at, spare):
        found = []
        if k == len(judged) and at in ("", "a"):
            found.append((0, "", ()))

        def add(cost, edit, line, rest):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1], ((line,) if line is not None else ()) + rest[2]))

        if spare:
            for role in ("user", "assistant"):
                if (at, role[0]) in steps:
                    add(5, "I", f"{role}:", best(k, steps[at, role[0]], spare - 1))
        if k < len(judged):
            role, text, fault = judged[k]
            add(2, "D", None, best(k + 1, at, 2))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if (at, role[:1]) in steps:
                    add(more, "K", f"{role}:{text}", best(k + 1, steps[at, role[:1]], 2))
                for new in ("user", "assistant"):
                    if (at, new[0]) in steps:
                        add(more + 1, "R", f"{new}:{text}", best(k + 1, steps[at, new[0]], 2))
        return min(found) if found else None

    return best(0, "", 2)


def _brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in _damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        said = [(r[2], r[3]) for r in own]
        faults = [_fault(s, said[:k]) for k, s in enumerate(said)]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, lines = _cheapest(said)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _found(spark, rows, bits=10, extra=()):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for name in extra:
        turns = turns.withColumn(name, F.lit("x"))
    edits, summary = R.repair(R.damage(turns), bits)
    asked = turns.select("conv_id").distinct().withColumn("key", R.conversation_key())
    got = asked.join(summary, "key", "left").join(R.digests(edits), "key", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (*(r[c] or 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), r["audit"] or "", r["repaired_sha256"] or empty) for r in got}


def _random_rows(seed, conversations, most):
    import random

    draw = random.Random(seed)
    return [
        (draw.choice([conv, conv]), draw.choice([k, k, k, k + 3, None]), draw.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]),
         draw.choice(["Yes.", "No!", "open", " \t", "", None, f"Number {k}.", f"Why {k}? ", f"cut {k}"]))
        for conv in [*range(conversations), None] for k in range(draw.randint(1, most))]


@pytest.mark.parametrize("bits", [10, 3, 1])
def test_brute_force(spark, bits):
    rows = _random_rows(bits, 60, 7)
    assert _found(spark, rows, bits) == _brute(rows)


def test_long_conversation_over_many_blocks(spark):
    rows = _random_rows(5, 3, 60) + [(9, k, "user" if k % 3 else "assistant", f"{k}." if k % 7 else "Again.") for k in range(250)]
    assert _found(spark, rows, 2) == _brute(rows)


def test_repeated_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ok.")] * 300 + [(2, None, "user", f"{k}.") for k in range(50)] + [(3, None, None, None)] * 5
    assert _found(spark, rows, 4) == _brute(rows)


def test_clashing_columns_and_empty(spark):
    rows = _random_rows(8, 6, 5)
    assert _found(spark, rows, extra=["key", "g", "fate", "copy", "times", "at", "block", "edit", "step"]) == _brute(rows)
    assert _found(spark, []) == {}


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a" * 2_000_000 + "."), (1, 1, "assistant", " " * 500_000 + "ok" + "\n" * 500_000)]
    assert _found(spark, rows) == _brute(rows)


ROW = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans())


@settings(max_examples=150, deadline=None)
@given(st.lists(ROW, max_size=8), st.integers(0, 8))
def test_passages_join(rows, cut):
    """Costs through two halves are those through the whole."""
    end = R._END
    whole = R.costs(rows, end)[0]
    assert R._through(R.passage(rows), end) == whole
    halves = R._joined(R.passage(rows[:cut]), R.passage(rows[cut:])) if rows[:cut] and rows[cut:] else R.passage(rows)
    assert R._through(halves, end) == whole


@settings(max_examples=80, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=9))
def test_least_paths(rows):
    """Ranks choose what the comparison of all whole audits chooses."""
    arcs = R.optimal_arcs(rows, R.costs(rows, R._END), 0)
    nodes = (len(rows) + 1) * R.PLACES
    edit, pointers = R.least_paths(nodes, arcs)
    after = {}
    for a, e, b in arcs:
        after.setdefault(a, []).append((e, b))

    @lru_cache(None)
    def least(node):
        return min(((e, *least(b)) for e, b in after.get(node, [])), default=())

    paths = R.read_off(R.np.arange(nodes), pointers)
    for node in range(nodes):
        assert tuple(int(edit[n]) for n in paths[node] if edit[n]) == least(node)
