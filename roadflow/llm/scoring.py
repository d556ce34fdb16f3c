"""Pseudo-likelihood of documents under a bidirectional window network, trained on the corpus itself."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.llm.names import free_names
from roadflow.session import cut_lineage

#: Words are numbered below GROUPS * GROUPS; 0 stands beyond a text's ends, the next ones for all other words by a hash.
GROUPS = 32
WORDS = GROUPS * GROUPS
OTHERS = 63
REACH = 2
WIDTH = 16
_ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

Parameters = dict[str, np.ndarray]


def shapes() -> dict[str, tuple[int, ...]]:
    return {
        "near": (2 * REACH, WORDS, WIDTH), "near_bias": (WIDTH,),
        "group": (WIDTH, GROUPS), "group_bias": (GROUPS,),
        "shift": (GROUPS, WIDTH), "member": (WIDTH, GROUPS), "member_bias": (GROUPS, GROUPS),
    }


def initial(seed: int = 5) -> Parameters:
    rng = np.random.default_rng(seed)
    return {n: (rng.normal(size=s) * 0.1 if not n.endswith("bias") else np.zeros(s)).astype(np.float32) for n, s in shapes().items()}


def packed(parameters: Parameters) -> np.ndarray:
    return np.concatenate([parameters[n].ravel() for n in shapes()])


def unpacked(flat: np.ndarray) -> Parameters:
    out, at = {}, 0
    for name, shape in shapes().items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


class WordNumbers(dict):
    """Numbers of the known words; any other word gets one of a few by its checksum."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: 1 + OTHERS + k for k, w in enumerate(words[: WORDS - 1 - OTHERS])})
        self._room = len(self) + (1 << 19)

    def __missing__(self, word: bytes) -> int:
        number = 1 + zlib.crc32(word) % OTHERS
        if len(self) < self._room:
            self[word] = number
        return number


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_ASCII_LOWER).split()


#: Logits up to here have exponentials, and sums of these, within single precision.
_FAR = 60.0


def _near_zero(logits: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The logits of inputs within -1 to 1, moved by a row's largest where the weights let them reach far."""
    if not np.abs(weights).sum(0).max() + np.abs(bias).max() < _FAR:
        logits -= logits.max(1, keepdims=True)
    return logits


def _sums(rows: np.ndarray) -> np.ndarray:
    return rows @ np.ones(rows.shape[1], rows.dtype)


def _forward(p: Parameters, stream: np.ndarray, at: np.ndarray):
    """Hidden layers and logits of the groups, and of the members of the true group, at each place."""
    around = [stream.take(at + d) for d in range(-REACH, REACH + 1) if d]
    hidden = p["near"][0].take(around[0], 0)
    for k in range(1, 2 * REACH):
        hidden += p["near"][k].take(around[k], 0)
    hidden += p["near_bias"]
    np.tanh(hidden, out=hidden)
    group, member = np.divmod(stream.take(at), GROUPS)
    groups = hidden @ p["group"]
    groups += p["group_bias"]
    turned = p["shift"].take(group, 0)
    turned += hidden
    np.tanh(turned, out=turned)
    members = turned @ p["member"]
    members += p["member_bias"].take(group, 0)
    return (around, hidden, group, member, _near_zero(groups, p["group"], p["group_bias"]), turned,
            _near_zero(members, p["member"], p["member_bias"]))


def log_likelihoods(p: Parameters, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(word | two words before, two words behind) at each place of the stream."""
    _, _, group, member, groups, _, members = _forward(p, stream, at)
    rows = np.arange(len(at))
    true = groups[rows, group] + members[rows, member]
    return true - np.log(_sums(np.exp(groups, out=groups))) - np.log(_sums(np.exp(members, out=members)))


class Trainer:
    """Steps of adaptive gradient descent on the negative log-likelihood."""

    def __init__(self, parameters: Parameters, rate: float = 0.1):
        self.p = {n: v.copy() for n, v in parameters.items()}
        self.squares = {n: np.full_like(v, 1e-6) for n, v in self.p.items()}
        self.rate = rate

    def _apply(self, name: str, gradient: np.ndarray) -> None:
        self.squares[name] += gradient * gradient
        self.p[name] -= self.rate * gradient / np.sqrt(self.squares[name])

    def step(self, stream: np.ndarray, at: np.ndarray) -> None:
        p = self.p
        around, hidden, group, member, d_groups, turned, d_members = _forward(p, stream, at)
        rows = np.arange(len(at))
        for shares, true in ((d_groups, group), (d_members, member)):
            np.exp(shares, out=shares)
            shares /= _sums(shares)[:, None]
            shares[rows, true] -= 1
        in_group = np.zeros((len(at), GROUPS), hidden.dtype)
        in_group[rows, group] = 1
        d_turned = d_members @ p["member"].T
        d_turned *= 1 - turned * turned
        d_hidden = d_groups @ p["group"].T
        d_hidden += d_turned
        d_hidden *= 1 - hidden * hidden
        self._apply("group", hidden.T @ d_groups)
        self._apply("group_bias", _sums(d_groups.T))
        self._apply("member", turned.T @ d_members)
        self._apply("member_bias", in_group.T @ d_members)
        self._apply("shift", in_group.T @ d_turned)
        self._apply("near_bias", _sums(d_hidden.T))
        for k, words in enumerate(around):
            words = words.astype(np.uint16)
            order = np.argsort(words, kind="stable")
            sorted_ = words.take(order)
            edge = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            gradient = np.add.reduceat(d_hidden.take(order, 0), edge)
            touched = sorted_.take(edge)
            squares = self.squares["near"][k].take(touched, 0)
            squares += gradient * gradient
            self.squares["near"][k][touched] = squares
            gradient *= self.rate
            gradient /= np.sqrt(squares, out=squares)
            p["near"][k][touched] -= gradient


def _streams(source: Iterator[pa.RecordBatch], column: int, numbers: WordNumbers, words: int = 1 << 18, others: list | None = None):
    """``(batch, first row, lengths, stream, places)``: texts of a few rows as one stream with room beyond each end.

    ``others`` is filled with the words without a number of their own, in the order of their places.
    """
    for batch in source:
        texts = batch.column(column).cast(pa.binary())
        row = 0
        while row < batch.num_rows:
            begin, total, parts, lengths = row, 0, [np.zeros(REACH, np.int64)], []
            if others is not None:
                others.clear()
            while row < batch.num_rows and (row == begin or total < words) and row - begin < 1 << 16:
                found = words_of(texts[row].as_py() or b"")
                parts += [np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)), np.zeros(REACH, np.int64)]
                if others is not None:
                    others += map(found.__getitem__, np.flatnonzero(parts[-2] <= OTHERS).tolist())
                lengths.append(len(found))
                total += len(found)
                row += 1
            stream = np.concatenate(parts)
            length = np.array(lengths, np.int64)
            start = REACH + np.cumsum(length + REACH) - (length + REACH)
            places = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
            yield batch, begin, length, stream, places


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of every word of all documents."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found: Counter[bytes] = Counter()
            for value in batch.column(0).cast(pa.binary()):
                found.update(words_of(value.as_py() or b""))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> list[bytes]:
    """The most frequent words of all documents, counted in Spark; ties go to the smaller word."""
    counts = word_counts(docs, text) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS - 1 - OTHERS)
    return [bytes(r["word"]) for r in top.collect()]


_SLICES = T.StructType([
    T.StructField("slice", T.IntegerType()), T.StructField("task", T.LongType()), T.StructField("weight", T.DoubleType()),
    T.StructField("values", T.BinaryType())])


def _averaged(group: pa.Table) -> pa.Table:
    """The weighted mean of the parameter slices of a group, in the order of their tasks."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["task"], r["values"]))
    weight = sum(r["weight"] for r in rows)
    total = sum(np.frombuffer(r["values"], np.float32).astype(np.float64) * r["weight"] for r in rows) / weight
    return pa.Table.from_pylist(
        [{"slice": rows[0]["slice"], "task": rows[0]["task"], "weight": weight, "values": total.astype(np.float32).tobytes()}],
        pa.schema([("slice", pa.int32()), ("task", pa.int64()), ("weight", pa.float64()), ("values", pa.binary())]))


def targets(length: np.ndarray, turn: int, rounds: int = 2, stride: int | None = None) -> np.ndarray:
    """Which words of texts of these lengths, one text after the other, are targets in a round; other texts don't matter."""
    stride = rounds if stride is None else stride
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.flatnonzero((within - turn * stride // rounds) % stride == 0)


def train(docs: DataFrame, words: list[bytes], text: str = "text", rounds: int = 2, stride: int | None = None, batch_words: int = 2048, slices: int = 16) -> Parameters:
    """Fit the network on the words of all documents.

    In each round every task starts from the same parameters, steps through the
    texts it scans and hands its parameters back in slices; Spark averages them,
    weighted by the words seen, in two levels, so the driver gets one copy.  A
    round takes every ``stride``-th word of a text as target, another one each
    round, with all words as context.  With ``stride`` left out it is ``rounds``,
    and every word is a target once.
    """
    spark = docs.sparkSession
    flat = packed(initial())
    for turn in range(rounds):
        start = spark.sparkContext.broadcast((words, flat))

        def learn(source: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            known, first = start.value
            numbers, trainer = WordNumbers(known), Trainer(unpacked(first))
            seen, mark = 0, 0
            for _, _, length, stream, places in _streams(source, 0, numbers):
                mark = zlib.crc32(stream.tobytes(), mark)
                chosen = places[targets(length, turn, rounds, stride)]
                for at in range(0, len(chosen), batch_words):
                    trainer.step(stream, chosen[at : at + batch_words])
                seen += len(places)
            if seen:
                parts = np.array_split(packed(trainer.p).astype(np.float32), slices)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(slices), pa.int32()), pa.array([mark] * slices, pa.int64()), pa.array([float(seen)] * slices),
                    pa.array([x.tobytes() for x in parts], pa.binary())], _SLICES.names)

        partial = docs.select(text).mapInArrow(learn, _SLICES)
        some = partial.groupBy("slice", F.pmod("task", F.lit(64))).applyInArrow(_averaged, _SLICES)
        rows = some.groupBy("slice").applyInArrow(_averaged, _SLICES).orderBy("slice").collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])
    return unpacked(flat)


def class_totals(counts: DataFrame, words: list[bytes]) -> list[int]:
    """Occurrences of the words of each class, which are all but ``words``."""
    known = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words[: WORDS - 1 - OTHERS]], "word binary")
    rows = counts.join(known, "word", "left_anti").groupBy((F.crc32("word") % OTHERS).cast("int").alias("k")).agg(F.sum("n").alias("n")).collect()
    found = {r["k"]: r["n"] for r in rows}
    return [found.get(k, 0) for k in range(OTHERS)]


#: log P(word | class) = log((n + 257 ** -(bytes + 1)) / (occurrences of the class + 1)): counts, with one occurrence more
#: for all words of any bytes together, so a word never counted has a probability too.
_BYTE = float(np.log(257))

_FOUND = T.StructType([
    T.StructField("range", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
    T.StructField("values", T.BinaryType())])
_PARTS = T.StructType([
    T.StructField("__chunk", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("rows", T.BinaryType()),
    T.StructField("sums", T.BinaryType())])
_MORE = T.StructType([T.StructField("__chunk", T.LongType()), T.StructField("__at", T.IntegerType()), T.StructField("__more", T.DoubleType())])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _in_ranges(hashes: np.ndarray, bits: int) -> tuple[list[int], np.ndarray]:
    """The ranges with some of the sorted ``hashes``, and the bounds of all ranges."""
    inner = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    bound = np.concatenate([[0], inner, [len(hashes)]])
    return np.flatnonzero(np.diff(bound)).tolist(), bound


def _where_found(others: list[bytes], row: np.ndarray, n_rows: int, bits: int) -> pa.Array:
    """The different words by hash, range by range, with the rows of their places, in the list of the first of ``n_rows`` rows."""
    hashes = _hashes(others)
    order = np.argsort(hashes, kind="stable")
    hashes, row = hashes.take(order), row.take(order).astype(np.uint16)
    place = np.append(np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])), len(hashes)) if others else np.zeros(1, np.int64)
    hashes, sizes = hashes.take(place[:-1]), np.diff(place).astype(np.int32)
    filled, bound = _in_ranges(hashes, bits)
    found = [(k, slice(bound[k], bound[k + 1]), slice(place[bound[k]], place[bound[k + 1]])) for k in filled]
    parts = pa.StructArray.from_arrays([
        pa.array(filled, pa.int32()), pa.array([hashes[x].tobytes() for _, x, _ in found], pa.binary()),
        pa.array([sizes[x].tobytes() for _, x, _ in found], pa.binary()),
        pa.array([row[y].tobytes() for _, _, y in found], pa.binary())], _FOUND.names)
    bounds = np.full(n_rows + 1, len(filled), np.int32)
    bounds[0] = 0
    return pa.ListArray.from_arrays(pa.array(bounds), parts)


def _count_ranges(counts: DataFrame, bits: int) -> DataFrame:
    """What each counted word has more than one never counted, as a logarithm, by ranges of hashes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(words: list[bytes], n: list[int]) -> pa.RecordBatch:
            spread = -_BYTE * (1 + np.fromiter(map(len, words), np.int64, len(words)))
            value = np.log(np.array(n, np.float64) + np.exp(spread)) - spread
            hashes = _hashes(words)
            order = np.argsort(hashes)
            hashes, value = hashes[order], value[order]
            filled, bound = _in_ranges(hashes, bits)
            cut = [slice(bound[k], bound[k + 1]) for k in filled]
            return pa.RecordBatch.from_arrays([
                pa.array(filled, pa.int32()), pa.array([hashes[x].tobytes() for x in cut], pa.binary()), pa.nulls(len(filled), pa.binary()),
                pa.array([value[x].tobytes() for x in cut], pa.binary())], _FOUND.names)

        words, n = [], []
        for batch in source:
            words += batch.column(0).to_pylist()
            n += batch.column(1).to_pylist()
            if len(words) >= 1 << 18:
                yield put(words, n)
                words, n = [], []
        if words:
            yield put(words, n)

    return counts.select("word", "n").mapInArrow(run, _FOUND)


def _looked_up(group: pa.Table) -> pa.Table:
    """For each chunk of rows the sums over its words of a range."""
    chunks, hashes, sizes, values = (group.column(x).to_pylist() for x in ("__chunk", "hashes", "sizes", "values"))
    table = [k for k, chunk in enumerate(chunks) if chunk is None]
    known = np.concatenate([np.frombuffer(hashes[k], np.uint64) for k in table] or [np.zeros(0, np.uint64)])
    value = np.concatenate([np.frombuffer(values[k], np.float64) for k in table] or [np.zeros(0)])
    order = np.argsort(known)
    # The last entry answers hashes behind all others.
    known, value = np.append(known[order], np.uint64(0)), np.append(value[order], 0.0)
    out = []
    for chunk, name, size, row in zip(chunks, hashes, sizes, values):
        if chunk is None:
            continue
        name, row = np.frombuffer(name, np.uint64), np.frombuffer(row, np.uint16)
        at = np.searchsorted(known[:-1], name)
        each = np.repeat(np.where(known[at] == name, value[at], 0.0), np.frombuffer(size, np.int32))
        found = np.flatnonzero(np.bincount(row)).astype(np.uint16)
        out.append((chunk, found.tobytes(), np.bincount(row, each)[found].tobytes()))
    k = group.column("range")[0].as_py()
    return pa.Table.from_arrays([
        pa.array([x[0] for x in out], pa.int64()), pa.array([k] * len(out), pa.int32()),
        pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], _PARTS.names)


def _added(group: pa.Table) -> pa.Table:
    """The sums of each row of a chunk over all ranges, in their order."""
    parts = sorted(zip(*(group.column(x).to_pylist() for x in ("range", "rows", "sums"))))
    at = np.concatenate([np.frombuffer(x[1], np.uint16) for x in parts])
    total = np.bincount(at, np.concatenate([np.frombuffer(x[2], np.float64) for x in parts]))
    found = np.unique(at)
    return pa.Table.from_arrays([
        pa.array([group.column("__chunk")[0].as_py()] * len(found), pa.int64()), pa.array(found.astype(np.int32)), pa.array(total[found])], _MORE.names)


def score(
    docs: DataFrame, words: list[bytes], parameters: Parameters, text: str = "text", keep_columns: list[str] | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``n_scored``, ``log_prob`` and ``mean_log_prob`` to each document.

    ``log_prob`` is the sum over all words of log P(word | the two words on each
    side), for the whole text.  A text without words, or a null one, has 0 and a
    null mean.  Columns of these names are replaced.

    The network tells ``words`` from each other and puts any other word in a
    class.  With ``counts``, the table of all words, log P(word | class) is added
    for these; without it, they count with the probability of the class alone.
    Words meet the table by ranges of their 64-bit hashes: each few rows send
    their different words once, and get back one sum for a row and range.
    """
    names = ["n_scored", "log_prob", "mean_log_prob"]
    columns = [c for c in docs.columns if c not in names and (keep_columns is None or c in keep_columns)]
    shared = docs.sparkSession.sparkContext.broadcast((words, packed(parameters)))
    full = counts is not None
    words_in, chunk_id, row_at, found_in, added = free_names([*columns, *names], "__text", "__chunk", "__at", "__others", "__more")
    extra = [chunk_id, row_at, found_in] if full else []
    totals, bits = np.zeros(0), 5
    if full:
        totals = np.log(np.array(class_totals(counts, words), np.float64) + 1)
        bits = max(bits, int((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // (16 << 20)).bit_length())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        numbers, p = WordNumbers(known), unpacked(flat)
        others: list[bytes] | None = [] if full else None
        chunk = TaskContext.get().partitionId() << 32
        for batch, begin, length, stream, places in _streams(source, 0, numbers, others=others):
            parts = [log_likelihoods(p, stream, places[at : at + 2048]) for at in range(0, len(places), 2048)]
            each = np.concatenate(parts) if parts else np.zeros(0)
            row = np.repeat(np.arange(len(length)), length)
            if full:
                other = stream[places] <= OTHERS
                each = each.astype(np.float64)
                each[other] -= totals[stream[places][other] - 1] + _BYTE * (1 + np.fromiter(map(len, others), np.int64, len(others)))
            total = np.bincount(row, each, len(length))
            kept = batch.slice(begin, len(length))
            mean = pa.array(total / np.maximum(length, 1), pa.float64(), mask=length == 0)
            more = []
            if full:
                found = _where_found(others, row[other], len(length), bits)
                more = [pa.array(np.full(len(length), chunk)), pa.array(np.arange(len(length), dtype=np.int32)), found]
                chunk += 1
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[1:], pa.array(length), pa.array(total, pa.float64()), mean, *more], [*columns, *names, *extra])

    schema = T.StructType([
        *docs.select(*columns).schema.fields, T.StructField("n_scored", T.LongType()),
        T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    whole = T.StructType(schema.fields + [
        T.StructField(chunk_id, T.LongType()), T.StructField(row_at, T.IntegerType()),
        T.StructField(found_in, T.ArrayType(_FOUND))])
    out = docs.select(F.col(text).alias(words_in), *columns).mapInArrow(run, whole if full else schema)
    if not full:
        return out
    out = cut_lineage(out)
    sent = out.where(F.size(found_in) > 0).select(F.col(chunk_id).alias("__chunk"), F.inline(found_in))
    table = _count_ranges(counts, bits).withColumn("__chunk", F.lit(None).cast("long"))
    parts = sent.unionByName(table).groupBy("range").applyInArrow(_looked_up, _PARTS)
    more = parts.groupBy("__chunk").applyInArrow(_added, _MORE).toDF(chunk_id, row_at, added)
    log_prob = F.col("log_prob") + F.coalesce(added, F.lit(0.0))
    return out.drop(found_in).join(more, [chunk_id, row_at], "left").select(
        *columns, "n_scored", log_prob.alias("log_prob"), F.when(F.col("n_scored") > 0, log_prob / F.col("n_scored")).alias("mean_log_prob"))
