"""Repair of conversation structure: cheapest edits by dynamic programming, the least of them by prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.session import cut_lineage

BLANKS = " \t\n\x0b\f\r"
#: Places in ``(s?(ua)+)?``: nothing yet, after the system turn, after a user turn, after an assistant turn.
PLACES = 4
_KEEP: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The place that an inserted or reroled turn leads to: the user's or the assistant's.
_NEXT = [2, 2, 3, 2]
_EDITS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(1, 5)
_FAR = 1 << 40
#: Costs from each place to the end behind the last row, and the inserts they stand for.
_END = [0, 10, 5, 0]
_TAIL = ["", "ua", "a", ""]

Row = tuple[str, bool, bool]  # initial of the role, has to go, truncated


def costs(rows: list[Row], end: list[int]) -> list[list[int]]:
    """Least cost from each place before each row, and behind the last, to the end, given those behind the last row."""
    out = [end]
    for initial, must_go, truncated in reversed(rows):
        after = out[-1]
        here = [2 + c for c in after]
        if not must_go:
            more = 5 if truncated else 0
            for place in range(PLACES):
                kept = _KEEP[place].get(initial)
                if kept is not None:
                    here[place] = min(here[place], more + after[kept])
                here[place] = min(here[place], more + 1 + after[_NEXT[place]])
        user, assistant = min(here[2], 5 + here[3]), min(here[3], 5 + here[2])
        out.append([min(here[0], 5 + user), min(here[1], 5 + user), user, assistant])
    out.reverse()
    return out


def passage(rows: list[Row]) -> list[int]:
    """Least costs from each place before the rows to each place behind them, as 16 numbers."""
    columns = [costs(rows, [0 if t == end else _FAR for t in range(PLACES)])[0] for end in range(PLACES)]
    return [min(_FAR, columns[t][s]) for s in range(PLACES) for t in range(PLACES)]


def optimal_arcs(rows: list[Row], ahead: list[list[int]], first: int) -> list[tuple[int, int, int]]:
    """``(node, edit, node)`` for every edit that lies on a cheapest path; nodes are numbered from ``first``, row by row."""
    arcs = []
    for number, (initial, must_go, truncated) in enumerate(rows):
        here, after = ahead[number], ahead[number + 1]
        more = 5 if truncated else 0
        at, then = first + number * PLACES, first + (number + 1) * PLACES
        for place in range(PLACES):
            cost, onward, kept = here[place], _NEXT[place], _KEEP[place].get(initial)
            if 2 + after[place] == cost:
                arcs.append((at + place, DELETE, then + place))
            if 5 + here[onward] == cost:
                arcs.append((at + place, INSERT, at + onward))
            if not must_go:
                if kept is not None and more + after[kept] == cost:
                    arcs.append((at + place, KEEP, then + kept))
                if more + 1 + after[onward] == cost:
                    arcs.append((at + place, REROLE, then + onward))
    return arcs


def least_paths(nodes: int, arcs: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The edit that each node's least path begins with (0: none), and pointers 1, 2, 4, ... edits along these paths.

    Arcs are ranked by the first edit, then by the first 2, 4, ... edits of the
    least path that begins with them: the rank of twice a length is that of the
    pair of the arc's rank and the best rank at the node where the length ends.
    From a node an edit leads to one node only, so equal beginnings of one node
    are one path, and a path that has ended ranks before any that goes on.
    """
    own = np.array(arcs, np.int64).reshape(-1, 3)
    # A node without an arc is an end; it points to itself with the least label.
    ends = np.setdiff1d(np.arange(nodes), own[:, 0])
    own = np.concatenate([own, np.stack([ends, np.zeros_like(ends), ends], 1)])
    start, rank, reach = own[:, 0], own[:, 1], own[:, 2]

    def best(rank: np.ndarray) -> np.ndarray:
        """Each node's arc of the least rank."""
        order = np.lexsort((rank, start))
        return order[np.r_[True, np.diff(start[order]) > 0]]

    finished = np.zeros(nodes, bool)
    finished[ends] = True
    while not finished[reach].all():
        choice = best(rank)
        rank = np.unique(rank * (rank.max() + 1) + rank[choice[reach]], return_inverse=True)[1]
        reach = reach[choice[reach]]
    choice = best(rank)
    pointers = [own[choice, 2]]
    while not finished[pointers[-1]].all():
        pointers.append(pointers[-1][pointers[-1]])
    return own[choice, 1], pointers


def read_off(starts: np.ndarray, pointers: list[np.ndarray]) -> np.ndarray:
    """The nodes of the paths from ``starts``, a path a row; a path that has ended stays where it is."""
    paths = starts[:, None]
    for pointer in pointers:
        paths = np.concatenate([paths, pointer[paths]], axis=1)
    return paths


def _through(matrix: list[int], ahead: list[int]) -> list[int]:
    return [min(_FAR, *(matrix[s * PLACES + t] + ahead[t] for t in range(PLACES))) for s in range(PLACES)]


def _joined(first: list[int], second: list[int]) -> list[int]:
    """Costs through two passages after one another."""
    return [min(_FAR, *(first[s * PLACES + k] + second[k * PLACES + t] for k in range(PLACES))) for s in range(PLACES) for t in range(PLACES)]


def _chained(first: list[int], second: list[int]) -> list[int]:
    return [second[k] for k in first]


def _parents(children: DataFrame, bits: int, join: Callable) -> DataFrame:
    """One element per conversation and ``2**bits`` ids, joined in order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        values = table["value"].to_pylist()
        out = values[0]
        for value in values[1:]:
            out = join(out, value)
        return pa.table({"key": [table["key"][0].as_py()], "id": pa.array([table["id"][0].as_py() >> bits], pa.int64()), "value": pa.array([out], pa.list_(pa.int64()))})

    return children.groupBy("key", F.shiftright("id", bits).alias("above")).applyInArrow(run, "key string, id long, value array<long>")


def _handed_down(children: DataFrame, parents: DataFrame, bits: int, step: Callable, backwards: bool) -> DataFrame:
    """What each element is given by its parent and the siblings on its side: ``(key, id, value)``."""
    given = parents.select("key", F.col("id").alias("above"), F.col("value").alias("given"))
    both = children.withColumn("above", F.shiftright("id", bits)).join(given, ["key", "above"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "descending" if backwards else "ascending")])
        now, out = table["given"][0].as_py(), []
        for value in table["value"].to_pylist():
            out.append(now)
            now = step(value, now)
        return pa.table({"key": table["key"], "id": table["id"], "value": pa.array(out, pa.list_(pa.int64()))})

    return both.groupBy("key", "above").applyInArrow(run, "key string, id long, value array<long>")


def _over_blocks(blocks: DataFrame, bits: int, join: Callable, step: Callable, start: list[int], backwards: bool) -> DataFrame:
    """Hand ``start`` along each conversation's blocks, level by level, so that no group has more than ``2**bits`` elements."""
    levels = [blocks]
    while levels[-1].groupBy("key").count().where("count > 1").limit(1).count():
        levels.append(cut_lineage(_parents(levels[-1], bits, join)))
    given = levels[-1].select("key", "id", F.array(*[F.lit(x).cast("long") for x in start]).alias("value"))
    for level in reversed(levels[:-1]):
        given = _handed_down(level, given, bits, step, backwards)
    return cut_lineage(given)


def _by_conversation(table: pa.Table) -> Iterator[tuple[str, pa.Table, list[Row]]]:
    """The parts of a block that belong to one conversation each."""
    table = table.sort_by("g")
    keys = table["key"].to_pylist()
    begin = 0
    for end in range(1, len(keys) + 1):
        if end == len(keys) or keys[end] != keys[begin]:
            part = table.slice(begin, end - begin)
            yield keys[begin], part, list(zip(part["initial"].to_pylist(), part["must_go"].to_pylist(), part["truncated"].to_pylist()))
            begin = end


def _passages(table: pa.Table) -> pa.Table:
    found = [(key, part["block"][0].as_py(), passage(rows)) for key, part, rows in _by_conversation(table)]
    keys, ids, values = zip(*found)
    return pa.table({"key": pa.array(keys, pa.string()), "id": pa.array(ids, pa.int64()), "value": pa.array(values, pa.list_(pa.int64()))})


def _solved(table: pa.Table) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """The parts of a block with their first node, each node's first edit, and the doubled pointers."""
    parts, arcs, first = [], [], 0
    for key, part, rows in _by_conversation(table):
        end = part["ahead"][0].as_py() or _END
        arcs += optimal_arcs(rows, costs(rows, end), first)
        parts.append((key, part, rows, first))
        first += (len(rows) + 1) * PLACES
    return parts, *least_paths(first, arcs)


def _ways_out(table: pa.Table) -> pa.Table:
    """To which place behind the block the least path from each place before it leads."""
    parts, _, pointers = _solved(table)
    values = [[int(pointers[-1][first + place]) - first - len(rows) * PLACES for place in range(PLACES)] for _, _, rows, first in parts]
    return pa.table({"key": pa.array([p[0] for p in parts], pa.string()), "id": pa.array([p[1]["block"][0].as_py() for p in parts], pa.int64()),
                     "value": pa.array(values, pa.list_(pa.int64()))})


def _edits_of_block(table: pa.Table) -> pa.Table:
    """Per row what is inserted before it (initials), its edit, the place it leads to, and what is inserted behind the last one."""
    parts, edit_of, pointers = _solved(table)
    starts = np.array([first + (part["entry"][0].as_py() or 0) for _, part, _, first in parts], np.int64)
    g, before, edits, places, after = [], [], [], [], []
    for (_, part, rows, first), path in zip(parts, read_off(starts, pointers).tolist()):
        inserted = ""
        for node, then in zip(path, path[1:]):
            place = (then - first) % PLACES
            if edit_of[node] == INSERT:
                inserted += "u" if place == 2 else "a"
            elif edit_of[node]:
                before.append(inserted)
                edits.append(_EDITS[edit_of[node] - 1])
                places.append(place)
                inserted = ""
        g += part["g"].to_pylist()
        after += [""] * (len(rows) - 1) + [_TAIL[(path[-1] - first) % PLACES] if part["closes"][0].as_py() else ""]
    return pa.table({"g": pa.array(g, pa.int64()), "before": pa.array(before, pa.string()), "edit": pa.array(edits, pa.string()),
                     "place": pa.array(places, pa.int32()), "after": pa.array(after, pa.string())})


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` after a fixed damage, drawn by crc32 of ``conversation:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it the user's.  A null role or text, and
    a null in the drawn key, is one space; other columns are not carried.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spaced(conversation), F.lit(":"), spaced(turn)).cast("binary")) % 20
    own = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), fate.alias("fate"),
        spaced(role).alias("role"), spaced(text).alias("text"))
    return own.where("fate <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _numbered(turns: DataFrame) -> DataFrame:
    """One row per different (conversation, turn, role, text) with its number of repeats and its place ``g`` among all rows.

    Rows are sorted over all tasks, so a long conversation is dealt to many;
    rows of one turn number are told apart by role and text.
    """
    unique = turns.groupBy(conversation_key().alias("key"), "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    order = ["key", "turn", "role", "text"]
    placed = unique.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("at", F.monotonically_increasing_id()))
    # The number of the task stands above bit 33; its rows before become an offset. One row per task.
    task = F.shiftright("at", 33)
    sizes = placed.groupBy(task.alias("task")).count()
    offsets = sizes.select("task", F.expr("sum(count) OVER (ORDER BY task) - count").alias("offset"))
    return placed.withColumn("task", task).join(offsets, "task").withColumn(
        "g", F.col("offset") + F.expr("at & ((1L << 33) - 1)")).drop("task", "offset", "at")


def _judged(rows: DataFrame) -> DataFrame:
    """Add the first fault of each row: ``fault`` (blank, duplicate, truncated or empty), and ``initial`` of its role."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", said)
    again = rows.groupBy("key", "said").agg(F.min("g").alias("first_g"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    return rows.join(again, ["key", "said"], "left").select(
        "key", "turn", "role", "text", "times", "g", F.left(F.col("role"), F.lit(1)).alias("initial"),
        F.when(last == "", F.lit("blank")).when(F.col("g") > F.col("first_g"), F.lit("duplicate"))
        .when(~last.isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit("")).alias("fault"))


def _summary(rows: DataFrame, edits: DataFrame, bits: int) -> DataFrame:
    """Per conversation gaps, faults, illegal neighbours and cost."""
    size = 1 << bits
    border = F.when(F.col("g") % size == size - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shown = rows.select("key", "g", "initial", "times", F.explode(border).alias("carried")).withColumn("block", F.shiftright("g", bits) + F.col("carried"))
    window = W.partitionBy("block").orderBy("g")
    pair = F.when(F.lag("key").over(window) == F.col("key"), F.concat(F.lag("initial").over(window), "initial"))
    illegal = shown.withColumn("pair", pair).where("carried = 0").groupBy("key").agg(
        F.sum(F.col("times") - 1 + F.coalesce((~F.col("pair").isin("su", "ua", "au")).cast("long"), F.lit(0))).alias("illegal"))
    repeats = F.col("times") - 1
    faults = rows.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("times")).when(F.col("fault") == "blank", F.lit(0)).otherwise(repeats)).alias("duplicate"),
        F.sum((F.col("fault") == "truncated").cast("long")).alias("truncated"))
    paid = edits.groupBy("key").agg(F.sum("cost").alias("cost"))
    return faults.join(illegal, "key").join(paid, "key")


def _borders(plain: DataFrame, spread: DataFrame, bits: int) -> DataFrame:
    """``(key, block, ahead, entry, high)``: costs behind and place before each block of a conversation over several blocks."""
    long = cut_lineage(plain.join(spread, "key", "left_semi"))
    passages = cut_lineage(long.groupBy("block").applyInArrow(_passages, "key string, id long, value array<long>"))
    ahead = _over_blocks(passages, bits, _joined, _through, _END, backwards=True).select("key", F.col("id").alias("block"), F.col("value").alias("ahead"))
    ways = long.join(ahead, ["key", "block"]).groupBy("block").applyInArrow(_ways_out, "key string, id long, value array<long>")
    entry = _over_blocks(cut_lineage(ways), bits, _chained, lambda way, now: [way[now[0]]], [0], backwards=False)
    entry = entry.select("key", F.col("id").alias("block"), F.col("value")[0].alias("entry"))
    return ahead.join(entry, ["key", "block"]).join(spread.select("key", "high"), "key")


def repair(turns: DataFrame, bits: int = 10) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that give each conversation the roles ``(s?(ua)+)?``, among equals those of the least audit.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; its rows are taken by turn
    (nulls first), then role and text.  Keep costs 0, Rerole (to user or
    assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5; a
    truncated row that stays costs 5 more; blank and duplicate rows have to go.
    An audit is the initials of the edits in order.

    Returns two tables.  Edits: ``(key, g, step, edit, repeat, role, text, cost)`` in the
    order of ``g`` and ``step`` within a ``key`` (see ``conversation_key``), role and text as
    repaired; ``repeat`` counts equal deletes in a row.  Summary: ``(key, gaps, blank,
    duplicate, truncated, illegal, cost)``.

    Rows are numbered through and cut into blocks of ``2**bits``.  A conversation
    over several blocks is solved by passages: the costs through a block between
    all places are joined level by level, the costs ahead and the place of entry
    handed back down; so no task gets a whole long conversation.  Within a block
    the edits on cheapest paths are ranked by prefix doubling (``least_paths``).

    Null roles and texts count as one space; a null conversation is one of its
    own; all rows with null turns come first, in the order of role and text.
    Rows equal in all columns are duplicates of the first of them, however
    many.  Empty tables give empty ones.
    """
    turns = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = cut_lineage(_judged(_numbered(turns)))
    plain = rows.select(
        "key", "g", F.shiftright("g", bits).alias("block"), "initial",
        F.col("fault").isin("blank", "duplicate").alias("must_go"), (F.col("fault") == "truncated").alias("truncated"))
    spread = plain.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    spread = cut_lineage(spread)
    known = _borders(plain, spread, bits) if spread.limit(1).count() else spread.select(
        "key", F.col("low").alias("block"), F.array().cast("array<long>").alias("ahead"), F.lit(0).cast("long").alias("entry"), "high")
    asked = plain.join(known, ["key", "block"], "left").withColumn(
        "closes", F.coalesce(F.col("block") == F.col("high"), F.lit(True)))
    edits = asked.groupBy("block").applyInArrow(_edits_of_block, "g long, before string, edit string, place int, after string")

    def inserts(initials: Column) -> Column:
        return F.transform(F.split(initials, ""), lambda c: F.struct(
            F.lit("I").alias("edit"), F.lit(1).cast("long").alias("repeat"), F.when(c == "u", "user").otherwise("assistant").alias("role"),
            F.lit("").alias("text"), F.lit(5).cast("long").alias("cost")))

    def one(edit: Column, repeat: Column, role: Column, cost: Column) -> Column:
        return F.array(F.struct(edit.alias("edit"), repeat.cast("long").alias("repeat"), role.alias("role"), F.col("text").alias("text"), cost.cast("long").alias("cost")))

    edit, stays = F.col("edit"), F.when(F.col("fault") == "truncated", 5).otherwise(0)
    role = F.when(edit != "R", F.col("role")).when(F.col("place") == 2, F.lit("user")).otherwise(F.lit("assistant"))
    none = F.array().cast("array<struct<edit:string,repeat:bigint,role:string,text:string,cost:bigint>>")
    steps = F.concat(
        F.when(F.col("before") != "", inserts(F.col("before"))).otherwise(none),
        one(edit, F.lit(1), role, F.when(edit == "D", F.lit(2)).when(edit == "R", stays + 1).otherwise(stays)),
        F.when(F.col("times") > 1, one(F.lit("D"), F.col("times") - 1, F.col("role"), 2 * (F.col("times") - 1))).otherwise(none),
        F.when(F.col("after") != "", inserts(F.col("after"))).otherwise(none))
    written = rows.join(edits, "g").select("key", "g", F.posexplode(steps).alias("step", "one")).select("key", "g", "step", "one.*")
    written = cut_lineage(written)
    return written, _summary(rows, written, bits)


def conversation_key(conversation: str = "conv_id") -> Column:
    """The key of a conversation in the tables of ``repair``."""
    return F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit(""))


def digests(edits: DataFrame) -> DataFrame:
    """``(key, audit, repaired_sha256)``: the edits' initials, and the digest of the repaired ``role:text`` lines.

    Rows stream by in order; what a task holds of a conversation is its audit so far
    and the state of its digest, never its texts.
    """
    ordered = edits.select("key", "g", "step", "edit", "repeat", F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, digest, empty = None, [], hashlib.sha256(), True
        done: list[tuple[str, str, str]] = []

        def flush() -> pa.RecordBatch:
            keys, audits, hashes = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (keys, audits, hashes)], ["key", "audit", "repaired_sha256"])

        for batch in batches:
            for key, edit, repeat, line in zip(*(batch.column(c).to_pylist() for c in ("key", "edit", "repeat", "line"))):
                if key != current:
                    if current is not None:
                        done.append((current, "".join(audit), digest.hexdigest()))
                    current, audit, digest, empty = key, [], hashlib.sha256(), True
                audit.append(edit * repeat)
                if line is not None:
                    digest.update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
            if done:
                yield flush()
        if current is not None:
            done.append((current, "".join(audit), digest.hexdigest()))
            yield flush()

    return ordered.repartition("key").sortWithinPartitions("key", "g", "step").mapInArrow(run, "key string, audit string, repaired_sha256 string")
