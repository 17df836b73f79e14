"""Document quality from a linear-chain conditional random field over lines.

Each line that isn't blank is labelled good or bad from its own shape (letter case, symbols, digits, repeated
words) and that of the lines beside it. The field is fitted to labelled documents; their lines' labels are hidden, and
the document's label is evidence for each of them. Forward-backward gives each line's probability of being good; a document's evidence is their mean,
weighted by length, which a logistic curve fitted to the same documents turns into the score.

The fit uses at most ``MAX_DOCUMENTS`` labelled documents as a whole, those with the smallest hashes of their ids, of which
each is taken that still fits into ``MAX_LINES`` lines; one that doesn't is passed over, and the next one tried. It is an error if
there are labelled texts and none of them fits. Scoring covers whole texts of all. Labels, language, source and
id are no inputs of a score. Rows whose crc32 of the id's text divides by 5 are never learnt from.

Null and empty texts, and texts of white space, have no line and get the share of good among the learnt labels.
Null labels are no labels; several labels of one id count by their mean. Without any label to learn from every
score is 0.5. Repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.common import fresh, small_batches, stored, trimmed, whole_text

MAX_DOCUMENTS = 6000
MAX_LINES = 200_000
FOLDS = 5
BINS = 8
STEPS = 100
TRUST = 2.0
SHAPES = 10
REJECT_BELOW = 0.3

# classes of characters
OTHER, UPPER, LETTER, DIGIT, SPACE = range(5)
_CLASSES: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of each character up to U+2FFF, and LETTER for what lies beyond."""
    if not _CLASSES:
        table = np.full(0x3001, LETTER, dtype=np.uint8)
        for i in range(0x3000):
            c = chr(i)
            kinds = ((c.isupper(), UPPER), (c.isalpha(), LETTER), (c.isnumeric(), DIGIT), (c.isspace(), SPACE))
            table[i] = next((k for is_, k in kinds if is_), OTHER)
        _CLASSES.append(table)
    return _CLASSES[0]


def lines_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All lines of the texts that aren't blank, and how many each text has."""
    found, counts = [], []
    for text in texts:
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        found += lines
        counts.append(len(lines))
    return found, np.array(counts, dtype=np.int64)


def shapes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """SHAPES numbers for each line, and its length."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    if not len(lines):
        return np.zeros((0, SHAPES), dtype=np.float32), sizes
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = class_table()[np.minimum(codes, 0x3000)]
    starts = np.cumsum(sizes) - sizes

    def count(mask):
        return np.add.reduceat(mask, starts, dtype=np.int64).astype(np.float64)

    symbol = kind == OTHER
    ends = np.zeros(len(kind), dtype=bool)
    ends[np.r_[starts[1:], len(kind)] - 1] = True
    before_gap = ends | np.r_[kind[1:] == SPACE, False]
    doubled = symbol & np.r_[False, codes[1:] == codes[:-1]]
    upper, digit, space = count(kind == UPPER), count(kind == DIGIT), count(kind == SPACE)
    letters = upper + count(kind == LETTER)
    words, distinct, again = np.zeros((3, len(lines)))
    for i, line in enumerate(lines):
        found = line.split()
        words[i], distinct[i] = len(found), len(set(found))
        again[i] = sum(map(eq, found, found[1:]))
    at_least = np.maximum(words, 1)
    table = [
        np.log1p(sizes),
        upper / np.maximum(letters, 1),
        count(symbol) / sizes,
        digit / sizes,
        count(symbol & before_gap) / at_least,
        count(doubled) / sizes,
        distinct / at_least,
        again / at_least,
        (sizes - space) / at_least / 10,
        space / sizes,
    ]
    return np.stack(table, axis=1).astype(np.float32), sizes


def beside(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shapes of the lines before and after each line; zeros beyond a document's ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    used = counts > 0
    before[(ends - counts)[used]] = 0
    after[ends[used] - 1] = 0
    return before, after


class Lanes:
    """Documents side by side, longest first, so that step t works on the first so many lanes."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        self.counts = counts[self.order]
        self.first = (np.cumsum(counts) - counts)[self.order]
        steps = int(counts.max(initial=0))
        self.going = np.searchsorted(-self.counts, -np.arange(steps), side="left")

    def marginals(self, score: np.ndarray, change: np.ndarray):
        """log Z of all documents, P(good) of each line, and the expected number of each pair of labels.

        ``score`` is the log-weight of good over bad for each line, ``change`` that of each pair of labels.
        """
        n = len(score)
        forward, backward = np.zeros((2, n, 2))
        a00, a01, a10, a11 = change.ravel()
        for t, k in enumerate(self.going):
            at = self.first[:k] + t
            if t:
                last = forward[at - 1]
                forward[at, 0] = np.logaddexp(last[:, 0] + a00, last[:, 1] + a10)
                forward[at, 1] = np.logaddexp(last[:, 0] + a01, last[:, 1] + a11) + score[at]
            else:
                forward[at, 1] = score[at]
        for t in range(len(self.going) - 2, -1, -1):
            at = self.first[: self.going[t + 1]] + t
            bad, good = backward[at + 1, 0], backward[at + 1, 1] + score[at + 1]
            backward[at, 0] = np.logaddexp(a00 + bad, a01 + good)
            backward[at, 1] = np.logaddexp(a10 + bad, a11 + good)
        both = forward + backward
        total = np.logaddexp(both[:, 0], both[:, 1])
        pairs = np.zeros((2, 2))
        inner = np.ones(n, dtype=bool)
        used = self.counts > 0
        inner[self.first[used]] = False
        to = np.flatnonzero(inner)
        for i in (0, 1):
            for j in (0, 1):
                weight = forward[to - 1, i] + change[i, j] + backward[to, j] + (score[to] if j else 0)
                pairs[i, j] = np.exp(weight - total[to]).sum()
        return total[self.first[used]].sum(), np.exp(both[:, 1] - total), pairs


class Field:
    """Bins, weights and the curve of a fitted model; a few kB."""

    def __init__(self, own: np.ndarray):
        cuts = np.arange(1, BINS) / BINS
        self.edges = [np.unique(np.quantile(own[:, i], cuts)) for i in range(SHAPES)]
        self.mean, self.scale = own.mean(axis=0), own.std(axis=0) + 1e-6
        self.size = SHAPES * BINS + 2 * SHAPES + 1
        self.weights, self.change = np.zeros(self.size), np.zeros((2, 2))
        self.curve, self.prior = (4.0, -2.0), 0.5

    def inputs(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.zeros((len(own), self.size), dtype=np.float32)
        rows = np.arange(len(own))
        for i, edges in enumerate(self.edges):
            x[rows, i * BINS + np.searchsorted(edges, own[:, i], side="right")] = 1
        before, after = beside((own - self.mean) / self.scale, counts)
        x[:, SHAPES * BINS : SHAPES * BINS + SHAPES] = np.clip(before, -4, 4)
        x[:, SHAPES * BINS + SHAPES : -1] = np.clip(after, -4, 4)
        x[:, -1] = 1
        return x

    def fit(self, own: np.ndarray, counts: np.ndarray, good: np.ndarray, sizes: np.ndarray) -> None:
        """Adam on the likelihood of the documents' labels, then the curve on the documents' evidence.

        What lines are labelled is hidden: a document's label speaks for each of its lines with a weight of ``TRUST``
        only. So the slope is what the field expects with that evidence less what it expects without, in line labels
        as in pairs of them, and a good document may have bad lines and changes between the two.
        """
        x, lanes = self.inputs(own, counts), Lanes(counts)
        told = TRUST * (2 * np.repeat(good, counts) - 1)
        lines = max(len(told), 1)
        share = good[counts > 0]
        state = np.zeros((2, self.size + 4))
        for step in range(1, STEPS + 1):
            score = x @ self.weights
            _, p, pairs = lanes.marginals(score, self.change)
            _, seen, seen_pairs = lanes.marginals(score + told, self.change)
            slope = np.concatenate([x.T @ (seen - p), (seen_pairs - pairs).ravel()]) / lines
            slope -= 1e-4 * np.concatenate([self.weights, self.change.ravel()])
            state[0] = 0.9 * state[0] + 0.1 * slope
            state[1] = 0.99 * state[1] + 0.01 * slope**2
            move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.weights += move[:-4]
            self.change += move[-4:].reshape(2, 2)
        self.prior = float(good.mean()) if len(good) else 0.5
        evidence = self.evidence(own, counts, sizes)[counts > 0]
        a, b = 4.0, -2.0
        for _ in range(50):  # Newton steps, lightly held back
            p = 1 / (1 + np.exp(-np.clip(a * evidence + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((share - p) * evidence).sum() - 0.1 * a, (share - p).sum() - 0.1 * b])
            h = np.array([[(w * evidence**2).sum() + 0.1, (w * evidence).sum()], [(w * evidence).sum(), w.sum() + 0.1]])
            da, db = np.clip(np.linalg.solve(h, g), -2, 2)
            a, b = a + da, b + db
        self.curve = (float(a), float(b))

    def evidence(self, own: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The length-weighted mean of P(good) over each document's lines; nan without lines."""
        out = np.full(len(counts), np.nan)
        if len(own):
            p = Lanes(counts).marginals(self.inputs(own, counts) @ self.weights, self.change)[1]
            used = counts > 0
            starts = (np.cumsum(counts) - counts)[used]
            out[used] = np.add.reduceat(p * sizes, starts) / np.add.reduceat(sizes, starts)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        lines, counts = lines_of(texts)
        own, sizes = shapes(lines)
        a, b = self.curve
        found = 1 / (1 + np.exp(-np.clip(a * self.evidence(own, counts, sizes) + b, -30, 30)))
        return np.where(counts > 0, found, self.prior)


def fold_of(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> Field | None:
    """A model of the labels of at most MAX_DOCUMENTS documents outside the held-out fold, MAX_LINES lines in all."""
    small_batches(docs.sparkSession)
    learnt = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    learnt = learnt.filter("_id is not null and _y is not null").filter(fold_of("_id") != 0)
    learnt = learnt.groupBy("_id").agg(F.avg("_y").alias("_y"))
    turn = F.md5(F.col("_id").cast("string").cast("binary"))
    learnt = learnt.orderBy(turn, "_id").limit(MAX_DOCUMENTS)
    rows = docs.select(F.col(id_col).alias("_key"), whole_text(text_col).alias("_text"))
    found = rows.join(F.broadcast(learnt), F.col("_key") == F.col("_id"))
    found = found.select("_id", "_y", F.xxhash64("_text").alias("_th"), "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, counts = lines_of(batch["_text"].to_pylist())
            own, sizes = shapes(lines)
            ends = np.cumsum(counts).tolist()
            cuts = list(zip([0, *ends], ends, strict=False))
            arrays = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (own, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["_id", "_y", "_th", "own", "sizes"])

    kind = T.StructType([*found.schema.fields[:3], *T._parse_datatype_string("own binary, sizes binary")])
    # of rows that repeat an id one is learnt from
    once = found.mapInArrow(trimmed(work), kind).groupBy("_id", "_y").agg(F.min(F.struct("_th", "own", "sizes")).alias("one"))
    once = once.select("_id", "_y", turn.alias("turn"), "one.own", "one.sizes", (F.octet_length("one.sizes") / 8).cast("long").alias("n"))
    once = stored(once, "quality-learnt")
    fit, room, seen = [], MAX_LINES, 0
    for r in once.select("_id", "turn", "n").orderBy("turn", "_id").collect():  # MAX_DOCUMENTS rows at most
        seen += r["n"]
        if r["n"] <= room:
            fit.append((r["_id"],))
            room -= r["n"]
    if seen and room == MAX_LINES:
        raise ValueError(f"none of the labelled documents has {MAX_LINES} lines or fewer; raise MAX_LINES")
    if not fit:
        return None
    ids = docs.sparkSession.createDataFrame(fit, T.StructType([once.schema["_id"]]))
    taken = once.join(F.broadcast(ids), "_id", "left_semi").orderBy("turn", "_id").collect()
    own = np.concatenate([np.frombuffer(r["own"], dtype=np.float32) for r in taken]).reshape(-1, SHAPES)
    each = [np.frombuffer(r["sizes"], dtype=np.int64) for r in taken]
    if not len(own):
        return None
    model = Field(own)
    counts = np.array([len(s) for s in each], dtype=np.int64)
    model.fit(own, counts, np.array([r["_y"] for r in taken], dtype=np.float64), np.concatenate(each))
    return model


def with_score(docs: DataFrame, model: Field | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``, the score of each whole text; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    data = pickle.dumps(model)
    rows = docs.withColumn(fresh(docs, "_scored"), whole_text(text_col)).drop(name)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(data)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = field.score(texts) if field else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], schema.names)

    return rows.mapInArrow(trimmed(work), schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that score REJECT_BELOW or more, with their columns as they were."""
    model = fit_quality(docs, labels, id_col, text_col)
    name = fresh(docs, "_score")
    return with_score(docs, model, text_col, name).filter(F.col(name) >= REJECT_BELOW).drop(name)
