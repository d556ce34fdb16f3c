"""Toxicity by weak supervision: many voters, a generative model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.llm.shared_search import term_pieces
from roadflow.session import cut_lineage, discard

#: Common English insults; voters from the start, also where no label says so. Fixed values.
INSULTS = (
    "ass asshole bastard bitch clown crap cunt damn degenerate disgusting dumb dumbass fool freak fuck garbage hate idiot imbecile jerk kill "
    "loser moron pathetic pig retard scum shit shut slut stupid trash ugly vermin whore worthless"
).split()
#: Digits read as letters in disguised words. Fixed values.
_DISGUISES = str.maketrans("013457", "oieast")
_RUN = re.compile(r"(.)\1{2,}")
_WORD = re.compile(r"\w+")
_LONGEST, _BEGINNINGS, _REMEMBERED = 64, range(3, 8), 1 << 18


def signs(word: str) -> list[str]:
    """What a word can be voted on by: itself, its beginnings of three to seven letters (``abc*``), its undisguised form (``~``)."""
    found = [word] if len(word) <= _LONGEST else []
    found += [f"{word[:k]}*" for k in _BEGINNINGS if k <= len(word)]
    plain = _RUN.sub(r"\1", word[:_LONGEST].translate(_DISGUISES))
    if plain != word[:_LONGEST] and len(plain) > 2:
        found.append(f"~{plain}")
    return found


class SignReader:
    """The signs of whole texts, or of those the ones with a number; the signs of a word are kept as long as there is room."""

    def __init__(self, numbers: dict[str, int] | None = None):
        self.numbers = numbers
        self.known: dict[bytes, tuple] = {}

    def _of_word(self, raw: bytes) -> tuple:
        found = [s for word in _WORD.findall(raw.decode()) for s in signs(word)]
        if self.numbers is not None:
            found = [self.numbers[s] for s in found if s in self.numbers]
        return tuple(dict.fromkeys(found))

    def read(self, text: str | None) -> list:
        if not text:
            return []
        words: set[bytes] = set()
        for piece in term_pieces(text.lower().encode()):
            words.update(piece)
        found: set = set()
        for word in words:
            signs_of = self.known.get(word)
            if signs_of is None:
                signs_of = self._of_word(word)
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[word] = signs_of
            found.update(signs_of)
        return sorted(found)


@dataclass
class Model:
    """Weights of signs; the voters and what the label model found of them are kept for inspection."""

    signs: list[str]
    weights: np.ndarray
    bias: float
    voters: list[str] = field(default_factory=list)
    fires: np.ndarray | None = None  # 2 x voters: how often each fires on rows that are not, and that are, toxic
    discount: np.ndarray | None = None  # by how much of its own weight each voter counts, after correlations


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int, folds: int) -> DataFrame:
    """``(text, toxic)`` of labelled documents outside the held-out fold; at most about ``sample_rows`` labels, drawn by a hash of the key.

    Labels of one key are settled by majority, toxic on a tie.  The drawn
    labels have a fixed bound of rows and are broadcast, so texts stay in place.
    """
    settled = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds)).groupBy(F.col(key).alias("key")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("toxic"))
    n = settled.count()
    drawn = settled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(min(1 << 30, (sample_rows << 30) // max(1, n))))
    drawn = cut_lineage(drawn)
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return own.join(F.broadcast(drawn), "key").select("text", "toxic")


def _sign_counts(texts: DataFrame, least: int) -> DataFrame:
    """``(sign, n)``: in how many texts each sign occurs, those of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = SignReader(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["sign", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(reader.read(text.as_py()))
                if len(counts) > 1 << 19:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "sign string, n long").groupBy("sign").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


_ROWS = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("signs", T.ArrayType(T.IntegerType()))])


def _read_signs(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(toxic, signs)``: the numbers of the named signs in each text."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps({s: k for k, s in enumerate(names)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SignReader(pickle.loads(shared.value))
        for batch in batches:
            found = [reader.read(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "signs"])

    return rows.mapInArrow(run, _ROWS)


def _chosen(counted: list, toxic: int, clean: int, features: int) -> list[tuple[float, str, float, float]]:
    """``(z, sign, n toxic, n clean)`` of the signs whose share differs most between both kinds, by the z-score of the log ratio."""
    out = []
    for sign, n1, n0 in counted:
        lift = math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))
        out.append((lift / math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)), sign, n1, n0))
    out.sort(key=lambda r: (-abs(r[0]), r[1]))
    return out[:features]


def _voters(chosen: list, most: int) -> list[int]:
    """Signs that stand for toxic rows more often than not; of a word and its beginnings that hit the same rows only the first."""
    out: list[int] = []
    taken: dict[str, list[float]] = {}
    for number, (z, sign, n1, n0) in enumerate(chosen):
        stem = sign.strip("~*")[:3]
        if z < 3 or n1 <= n0 or any(abs(n1 - other) <= 0.1 * other for other in taken.get(stem, [])):
            continue
        taken.setdefault(stem, []).append(n1)
        out.append(number)
        if len(out) == most:
            break
    return out


def _summed(rows: DataFrame, size: int, of_batch: Callable) -> np.ndarray:
    """The sum over all rows of what ``of_batch(toxic, row numbers, signs)`` returns for batches of them; one vector comes from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            lists = batch.column(1)
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            total += of_batch(batch.column(0).to_numpy(zero_copy_only=False).astype(float), of, lists.flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return np.sum([np.frombuffer(r[0]) for r in rows.mapInArrow(run, "total binary").collect()], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class LabelModel:
    """Voters that fire or do not, given a hidden class, with pairwise correlations; the given label is one more, fallible voter.

    A voter's evidence is divided by one plus its correlations with the others
    within the classes (those above ``noise``), so voters that repeat each
    other count about once.
    """

    noise = 0.1

    def __init__(self, voters: int):
        self.n = voters
        self.prior = 0.5
        self.fires = np.full((2, voters), 0.5)
        self.label = np.array([0.05, 0.95])  # how often the label says toxic, by class
        self.discount = np.ones(voters)
        self.first = True

    def posterior(self, toxic: np.ndarray, votes: np.ndarray) -> np.ndarray:
        said = np.log(self.label[1] / self.label[0]) * toxic + np.log((1 - self.label[1]) / (1 - self.label[0])) * (1 - toxic)
        if self.first:
            return _sigmoid(said)
        yes = np.log(self.fires[1] / self.fires[0]) * self.discount
        no = np.log((1 - self.fires[1]) / (1 - self.fires[0])) * self.discount
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + said + votes @ (yes - no) + no.sum())

    def statistics(self, toxic: np.ndarray, votes: np.ndarray) -> np.ndarray:
        p = self.posterior(toxic, votes)
        parts = []
        for weight in (1 - p, p):
            weighted = votes * weight[:, None]
            parts += [[weight.sum(), weight @ toxic], weighted.sum(0), (votes.T @ weighted).ravel()]
        return np.concatenate(parts)

    def update(self, sums: np.ndarray) -> None:
        half = len(sums) // 2
        size, correlation = np.zeros(2), np.zeros((self.n, self.n))
        for k in range(2):
            part = sums[k * half : (k + 1) * half]
            size[k] = part[0]
            self.label[k] = np.clip((part[1] + 1) / (size[k] + 2), *((0.002, 0.4), (0.6, 0.998))[k])
            fires = (part[2 : 2 + self.n] + 0.1) / (size[k] + 1)
            both = part[2 + self.n :].reshape(self.n, self.n) / max(size[k], 1)
            self.fires[k] = np.clip(fires, 1e-4, 1 - 1e-4)
            spread = np.sqrt(fires * (1 - fires))
            correlation += (both - np.outer(fires, fires)) / np.maximum(np.outer(spread, spread), 1e-9) / 2
        np.fill_diagonal(correlation, 0)
        self.discount = 1 / (1 + np.where(correlation > self.noise, correlation, 0).sum(1))
        self.prior = float(np.clip(size[1] / max(size.sum(), 1), 1e-3, 1 - 1e-3))
        self.first = False


def _votes(rows: int, of: np.ndarray, signs_of: np.ndarray, place: np.ndarray, voters: int) -> np.ndarray:
    votes = np.zeros((rows, voters + 1))
    votes[of, place[signs_of]] = 1
    return votes[:, :voters]


def fit_label_model(rows: DataFrame, voters: list[int], signs_: int, rounds: int = 8) -> LabelModel:
    """Expectation and maximisation over all rows; a round is one pass that sums each class's firings, single and in pairs."""
    model = LabelModel(len(voters))
    place = np.full(max(1, signs_), len(voters))
    place[voters] = np.arange(len(voters))
    for _ in range(rounds):
        held = model

        def sums(toxic, of, signs_of, held=held):
            return held.statistics(toxic, _votes(len(toxic), of, signs_of, place, held.n))

        model.update(_summed(rows, 2 * (2 + model.n + model.n**2), sums))
    return model


def fit_linear(rows: DataFrame, model: LabelModel, voters: list[int], signs_: int, n: int, l2: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights and bias of a logistic regression on posterior labels, by L-BFGS; a step is one pass that sums loss and gradient."""
    place = np.full(max(1, signs_), len(voters))
    place[voters] = np.arange(len(voters))

    def loss_of(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(toxic, of, signs_of):
            p = model.posterior(toxic, _votes(len(toxic), of, signs_of, place, model.n))
            x = np.bincount(of, weights[signs_of], len(toxic)) + weights[-1]
            off = _sigmoid(x) - p
            loss = (np.logaddexp(0, x) - p * x).sum()
            return np.concatenate([[loss], np.bincount(signs_of, off[of], signs_), [off.sum()]])

        total = _summed(rows, signs_ + 2, sums)
        decay = np.r_[weights[:-1], 0] * l2
        return (total[0] + weights @ decay / 2) / n, (total[1:] + decay) / n

    return minimise(loss_of, np.zeros(signs_ + 1), rounds)


def minimise(loss_of: Callable, weights: np.ndarray, rounds: int, memory: int = 8, enough: float = 1e-5) -> np.ndarray:
    """L-BFGS with step halving."""
    loss, slope = loss_of(weights)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < enough:
            break
        way, kept = -slope.copy(), []
        for s, y, r in reversed(steps):
            kept.append(r * (s @ way))
            way -= kept[-1] * y
        if steps:
            s, y, r = steps[-1]
            way *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(kept)):
            way += (a - r * (y @ way)) * s
        size = 1.0 if steps else min(1.0, 1 / max(1e-12, np.abs(slope).sum()))
        for _ in range(12):
            tried = weights + size * way
            new_loss, new_slope = loss_of(tried)
            if new_loss <= loss + 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        s, y = tried - weights, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        weights, loss, slope = tried, new_loss, new_slope
    return weights


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 1 << 17,
    features: int = 4096,
    voters: int = 96,
    support: float = 0.002,
    folds: int = 5,
) -> Model:
    """Learn from the texts and labels outside the held-out fold.

    ``sample_rows`` bounds the labels used.  Signs (``signs``) of at least three and a share
    ``support`` of the toxic rows are counted in all drawn rows; the ``features`` most telling ones
    are the classifier's, the best of them, as words and as patterns, and the words of ``INSULTS``, the ``voters``.  The
    label model gives each row a posterior from its votes and its fallible
    label; on these the classifier is fitted.

    Without labels of both kinds the insults alone decide.  Rows without text
    or label teach nothing; copies count as often as they occur.
    """
    rows = labelled_rows(docs, labels, key, text, label, sample_rows, folds)
    toxic = rows.where("toxic = 1").select("text")
    sizes = dict(map(tuple, rows.groupBy("toxic").count().collect()))
    if not sizes.get(0) or not sizes.get(1):
        return Model(list(INSULTS), np.full(len(INSULTS), 4.0), -2.0)
    seen = _sign_counts(toxic, max(3, math.ceil(support * sizes[1]))).orderBy(F.desc("n"), "sign").limit(16 * features)
    names = sorted({*(r[0] for r in seen.select("sign").collect()), *INSULTS})
    read = cut_lineage(_read_signs(rows, names))
    counts = read.select("toxic", F.explode("signs").alias("sign")).groupBy("sign").agg(
        F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).collect()
    found = _chosen([(names[s], n1, n0) for s, n1, n0 in counts], sizes[1], sizes[0], features)
    own = _voters(found, voters)
    own += [k for k, r in enumerate(found) if r[1] in INSULTS and k not in own]
    number = np.full(len(names), -1, np.int64)
    at = {name: k for k, name in enumerate(names)}
    for k, r in enumerate(found):
        number[at[r[1]]] = k

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[x for x in number[np.array(s, np.int64)].tolist() if x >= 0] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int32()))], ["toxic", "signs"])

    # Few files of bounded size: one vector a task comes to the driver in each pass.
    small = cut_lineage(read.mapInArrow(only, _ROWS).repartition(12))
    discard(read)
    label_model = fit_label_model(small, own, len(found))
    weights = fit_linear(small, label_model, own, len(found), sizes[0] + sizes[1])
    discard(small)
    return Model([r[1] for r in found], weights[:-1], float(weights[-1]), [found[k][1] for k in own], label_model.fires, label_model.discount)


def score(docs: DataFrame, model: Model, text: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to each document, from its whole text alone.

    A null or empty text has no signs and gets the score of that.  Columns of
    these names are replaced; ``keep_columns`` names those carried along (all by
    default).  Documents stay where they are.
    """
    columns = [c for c in docs.columns if c not in ("score", "predicted") and (keep_columns is None or c in keep_columns)]
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(({s: k for k, s in enumerate(model.signs)}, model.weights, model.bias)))
    wanted = [*columns, *([text] if text not in columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weights, bias = pickle.loads(shared.value)
        reader = SignReader(numbers)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            scores = _sigmoid(np.array([weights[reader.read(t.as_py())].sum() + bias for t in texts], float))
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
                [*columns, "score", "predicted"])

    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*wanted).mapInArrow(run, schema)
