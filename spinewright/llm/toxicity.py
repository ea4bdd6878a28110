"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine on labelled sentences.

A text is cut into sentences and these into pieces: words in lower case, look-alike digits and signs read as letters,
other signs left out, runs of spaced single letters joined, very long words in overlapping windows. Two pieces are
compared by the gap-weighted subsequence kernel of three letters: each common subsequence counts ``DECAY`` to the
power of its span, so gaps and inserted letters weaken a match but don't break it; a mark before the first letter is
part of the piece. The kernel is divided by a factor of each piece's length. Sentences are compared by the sum of
their pieces' kernels.

Training takes at most ``SAMPLE_DOCS`` labelled documents, in the order of a hash of the id, held-out rows left out;
nothing else is sampled. Landmarks of the Nyström map are pieces of the sample: half of them those most tied to one
label, half drawn by hash. The machine (squared hinge) is fitted on the map of labelled sentences, cut into runs of
``RUN`` pieces so that an insult isn't drowned by its neighbours. A document's label is that of its sentences: first of
all of them summed, then in ``ROUNDS`` rounds of those the last machine calls toxic (the highest one if there are
none; half of the machine's constant is enough in toxic documents), toxic documents giving their current ones, clean
ones those of all past rounds too, as a toxic document has a toxic sentence somewhere and a clean one has none. As the kernel's feature space is finite, the machine folds into one
weight for each letter triple. A logistic link over a document's strongest sentences and pieces gives the score. It is
fitted on values from machines of two halves of the sample, each of which scores the half it has not seen.

Only texts enter a score. Null and empty texts have no piece and get the link's score of no evidence; a model without
labels of both kinds gives every text the same score below 0.5. Labels of null are left out; an id with several labels
is toxic if one says so; of several texts with one id the one with the smallest hash is used for training, and every
one is scored. Copies of a text are one training text, toxic if one is. Equal scores of runs go to the earlier one. Very long texts are scored whole, sentence by
run by run. Repeated rows get a row each; an empty table gives none;
extra columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import materialize
from spinewright.llm.rows import gives_back, packed

#: Labelled documents a model is fitted on, at most.
SAMPLE_DOCS = 10_000
DECAY, MAX_SPAN, LETTERS = 0.7, 6, 64
#: Landmarks, rounds of picking sentences, and the machine's ridge for one document, which grows with the root of their number.
LANDMARKS, ROUNDS, PENALTY = 256, 3, 0.03
#: Letters of a window and between two of them; pieces of a sentence that are judged together.
WINDOW, STEP, RUN = 24, 12, 4
#: Documents of the sample a landmark must occur in.
LEAST_DOCS = 3
#: Tasks that work on the sample.
SAMPLE_TASKS = 32
#: The number of the link's features.
FEATURES = 8
#: Pieces whose values a task remembers; some megabytes.
_CACHE_PIECES = 60_000
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?!\S)")
_OTHER = re.compile(r"[\W\d_]+")
_ENDS = (".", "!", "?")


def sentences(text: str | None) -> list[list[str]]:
    """The pieces of each sentence, in runs of at most ``RUN``. A sentence ends with its line, or with a piece that ends in a full stop."""
    out: list[list[str]] = []
    if not text:
        return out
    low = text.lower()
    spaced = _SPACED.search(low) is not None
    for line in low.split("\n"):
        run: list[str] = []
        for word in line.split():
            run.append(word)
            if len(run) == RUN or word.endswith(_ENDS):
                out.append(run)
                run = []
        if run:
            out.append(run)
        if spaced:
            out += [[_OTHER.sub("", m)] for m in _SPACED.findall(line)]
    return out


def letters(piece: str) -> list[str]:
    """What the kernel sees of a piece: letters only, in windows of at most ``WINDOW``."""
    s = piece
    if not s.isalpha():
        s = _OTHER.sub("", s.strip("!?.,;:()[]{}\"'").translate(_LOOKALIKE)) if not s.isdigit() else ""
    if len(s) <= WINDOW:
        return [s] if len(s) > 1 else []
    return [s[i : i + WINDOW] for i in range(0, len(s) - STEP, STEP)]


def _codes(words: list[str]) -> np.ndarray:
    """Equally long words as rows of letter numbers, with the start mark 0 in front."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(words), -1)
    c = np.where((c >= 97) & (c <= 122), c - 96, 27 + c % (LETTERS - 27))
    return np.concatenate([np.zeros((len(words), 1), np.int64), c], axis=1)


def _triples(n: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i + 1)) for i in range(n) for k in range(i + 2, min(n, i + MAX_SPAN)) for j in range(i + 1, k)]


def _length_factor(n: int) -> float:
    return float(np.sqrt(sum(t[3] ** 2 for t in _triples(n)))) or 1.0


def _dot(words: list[str], weights: np.ndarray) -> np.ndarray:
    """For each word the product of its features and ``weights``, one for each letter triple."""
    out = np.zeros(len(words))
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by.setdefault(len(w), []).append(at)
    for n, where in by.items():
        i, j, k, v = _triple_arrays(n + 1)
        v = v / _length_factor(n + 1)
        for part in (where[x : x + 1024] for x in range(0, len(where), 1024)):
            c = _codes([words[x] for x in part])
            out[part] = weights[(c[:, i] * LETTERS + c[:, j]) * LETTERS + c[:, k]] @ v
    return out


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, values): a column for each word over the features that occur in any, and a last row of zeros."""
    found: list[dict[int, float]] = []
    for w in words:
        c, own = _codes([w])[0], Counter()
        for i, j, k, v in _triples(len(c)):
            own[int((c[i] * LETTERS + c[j]) * LETTERS + c[k])] += v / _length_factor(len(c))
        found.append(own)
    used = np.array(sorted(set().union(*found)), np.int64)
    row, out = {f: i for i, f in enumerate(used.tolist())}, np.zeros((len(used) + 1, len(words)))
    for at, own in enumerate(found):
        for f, v in own.items():
            out[row[f], at] = v
    return used, out


@dataclass
class Landmarks:
    """The Nyström map: ``used`` features, and for each of them (and a last row of zeros) its part in the map's columns."""

    used: np.ndarray
    to: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Landmarks:
        used, phi = _features(words)
        value, vector = np.linalg.eigh(phi.T @ phi)
        keep = value > 1e-6 * value.max()
        return cls(used, (phi @ (vector[:, keep] / np.sqrt(value[keep]))).astype(np.float32))

    def __post_init__(self) -> None:
        self._place = np.full(LETTERS**3, len(self.used), np.int32)
        self._place[self.used] = np.arange(len(self.used))

    def embed(self, words: list[str]) -> np.ndarray:
        """The map of a sentence, or of any list of pieces as the kernel sees them: the sum over the pieces."""
        total = np.zeros(len(self.used) + 1)
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, own in by.items():
            c = _codes(own)
            i, j, k, v = _triple_arrays(n + 1)
            if len(v):
                feature = self._place[(c[:, i] * LETTERS + c[:, j]) * LETTERS + c[:, k]]
                total += np.bincount(feature.ravel(), np.tile(v / _length_factor(n + 1), len(own)), len(total))
        some = np.flatnonzero(total[:-1])
        return total[some] @ self.to[some]

    def fold(self, w: np.ndarray) -> np.ndarray:
        """A machine on the map as one weight for each letter triple."""
        weights = np.zeros(LETTERS**3, np.float32)
        weights[self.used] = (self.to @ w)[:-1]
        return weights


@lru_cache(maxsize=64)
def _triple_arrays(n: int) -> tuple[np.ndarray, ...]:
    t = np.array(_triples(n), np.float64).reshape(-1, 4)
    return (*(t[:, i].astype(np.int64) for i in range(3)), t[:, 3])


class Values:
    """The machine's value of each piece, remembered."""

    def __init__(self, weights: np.ndarray):
        self.weights, self._cache = weights, {}

    def of(self, cut: list[list[list[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the values of its pieces, and the sum of each run."""
        unknown = {p for text in cut for s in text for p in s} - self._cache.keys()
        if len(self._cache) + len(unknown) > _CACHE_PIECES:
            self._cache.clear()
            unknown = {p for text in cut for s in text for p in s}
        parts = {p: letters(p) for p in unknown}
        flat = sorted({w for ws in parts.values() for w in ws})
        value = dict(zip(flat, _dot(flat, self.weights).tolist(), strict=True)) if flat else {}
        for p, ws in parts.items():
            self._cache[p] = max([value[w] for w in ws], default=0.0)
        get, out = self._cache, []
        for text in cut:
            every = np.array([get[p] for run in text for p in run])
            starts = np.cumsum([0, *map(len, text)])[:-1]
            out.append((every, np.add.reduceat(every, starts) if len(every) else every))
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    link: np.ndarray

    def __post_init__(self) -> None:
        self._values = Values(self.weights)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "link": self.link}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def describe(self, texts: list[str | None]) -> np.ndarray:
        """A row of the link's features for each text."""
        return described(self._values.of([sentences(t) for t in texts]), self.bias)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = self.describe(texts)
        z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ self.link
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _largest(x: np.ndarray, n: int) -> np.ndarray:
    return -np.sort(np.partition(-x, n - 1)[:n] if len(x) > n else -x)


def described(values: list[tuple[np.ndarray, np.ndarray]], bias: float) -> np.ndarray:
    """The link's features of texts, from the values of their pieces and runs."""
    rows = np.zeros((len(values), FEATURES))
    for row, (every, runs) in zip(rows, values, strict=True):
        if len(every):
            sums, most = _largest(runs, 2), _largest(every, 3)
            high = int((runs + bias > 0).sum())
            row[: len(sums)] = np.clip(sums, -1, 4)
            row[2:4] = np.log1p(high), np.sqrt(high / (len(runs) + 2))
            row[4 : 4 + len(most)] = np.clip(most, -1, 4)
            row[7] = np.log1p((every > 0.5).sum())
    return rows


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps, its constant last. Rows are summed up in blocks, so that no second
    matrix of their size is held."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    ridge = penalty * np.eye(n)
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(n)
        for at in range(0, len(x), 2048):
            block = np.concatenate([x[at : at + 2048], np.ones((len(x[at : at + 2048]), 1))], axis=1, dtype=np.float64)
            of, c = y[at : at + 2048], weight[at : at + 2048]
            inside = of * (block @ w) < 1
            block, c = block[inside], c[inside]
            left += (block.T * c) @ block
            right += (block.T * c) @ of[inside]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    x, w = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.zeros(x.shape[1] + 1)
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``text, toxic, h, half`` of at most ``limit`` labelled documents that are not held out."""
    of = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    of = of.withColumn("h", F.xxhash64(F.lit("sample"), F.col("doc_id"))).orderBy("h", "doc_id").limit(limit)
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    mine = texts.join(F.broadcast(of), "doc_id")  # ``limit`` rows bound the broadcast
    one = mine.groupBy("doc_id", "toxic", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    # copies count once, so that a text copied a thousand times teaches no more than another
    once = one.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("h").alias("h"))
    return once.select("text", "toxic", "h", F.pmod("h", F.lit(2)).cast("int").alias("half"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, docs) of a batch: in how many documents of either label the kernel sees a word."""
    for b in batches:
        docs: Counter = Counter()
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            docs.update((w, toxic) for w in {w for p in {p for s in sentences(text.as_py()) for p in s} for w in letters(p)})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in docs], pa.string()), pa.array([k[1] for k in docs], pa.int32()), pa.array(list(docs.values()), pa.int64())], ["word", "toxic", "docs"])


def landmarks(labelled: DataFrame, toxic: int, clean: int, number: int = LANDMARKS) -> list[str]:
    """Half of them the words whose share of toxic documents differs most from that of clean ones, in standard errors, half by hash."""
    t, c = (F.sum(F.when(F.col("toxic") == label, F.col("docs")).otherwise(0)) for label in (1, 0))
    counted = labelled.select("text", "toxic").mapInArrow(gives_back(_words), "word string, toxic int, docs long").groupBy("word").agg(t.alias("t"), c.alias("c"))
    share = (F.col("t") + F.col("c")) / (toxic + clean)
    tie = F.abs(F.col("t") / toxic - F.col("c") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12)
    words = counted.where(F.col("t") + F.col("c") >= LEAST_DOCS).select("word", tie.alias("tie"))
    words = materialize(words)
    tied = [r["word"] for r in words.orderBy(F.desc("tie"), "word").limit(number // 2).collect()]
    other = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(number).collect()]
    return (tied + [w for w in other if w not in tied])[:number]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows``, as texts cut into pieces take several times their size."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def _flat(runs: list[list[str]]) -> list[str]:
    return [w for run in runs for p in run for w in letters(p)]


def _instances(labelled: DataFrame, marks: Landmarks, machines: list[tuple[np.ndarray, float]] | None) -> tuple[np.ndarray, ...]:
    """Labels, halves, and the rows of either machine (its half's, and that of all) of each document: the map of all its
    runs, or of those that the machine calls toxic. The driver receives two short vectors a document of the sample."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [Values(w) for w, _ in machines or ()]
        for b in _small(batches):
            cut, labels, halves, out = [sentences(t.as_py()) for t in b.column(0)], b.column(1).to_pylist(), b.column(3).to_pylist(), ([], [])
            if machines is None:
                for text in cut:
                    pieces = {p for run in text for p in run}
                    x = (marks.embed(_flat(text)) / max(1.0, float(np.sqrt(len(pieces))))).astype(np.float32).tobytes()
                    out[0].append(x)
                    out[1].append(x)
            else:
                # a machine's values of all texts of the batch at once
                own = [dict(zip((i for i, h in enumerate(halves) if at in (h, 2)), values[at].of([t for t, h in zip(cut, halves, strict=True) if at in (h, 2)]), strict=True)) for at in range(3)]
                for i, (text, toxic, half) in enumerate(zip(cut, labels, halves, strict=True)):
                    for at, to in ((half, out[0]), (2, out[1])):
                        sums = own[at][i][1] + machines[at][1]
                        least = machines[at][1] / 2 if toxic else 0.0
                        pick = np.flatnonzero(sums > least) if (sums > least).any() else [int(sums.argmax())] if len(sums) else []
                        to.append((marks.embed(_flat([text[k] for k in pick])) / max(1.0, float(np.sqrt(len(pick))))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["toxic", "h", "half", "own", "all"])

    found = labelled.select("text", "toxic", "h", "half").mapInArrow(gives_back(made), "toxic int, h long, half int, own binary, all binary").toArrow()
    matrix = lambda name: np.frombuffer(b"".join(found[name].to_pylist()), np.float32).reshape(found.num_rows, -1)
    order = np.lexsort((found["toxic"].to_numpy(), found["h"].to_numpy()))  # so that sums are repeatable
    return found["toxic"].to_numpy()[order], found["half"].to_numpy()[order], matrix("own")[order], matrix("all")[order]


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Model:
    """Fit a model; what reaches the driver is bounded by ``limit`` and ``LANDMARKS``."""
    labelled = materialize(sample(docs, labels, limit).repartition(SAMPLE_TASKS, "h"))
    of = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = of.get(1, 0), of.get(0, 0)
    words = landmarks(labelled, toxic, clean) if toxic and clean else []
    if not words:  # nothing to learn from
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, np.array([0.0] * FEATURES + [-2.0]))
    marks = Landmarks.of(words)
    machines: list[tuple[np.ndarray, float]] | None = None
    clean_seen: list[list[np.ndarray]] = [[], [], []]
    for _ in range(ROUNDS + 1):
        label, half, own, every = _instances(labelled, marks, machines)
        fitted = []
        for at in range(3):
            x, y = (every, label) if at == 2 else (own[half == at], label[half == at])
            clean_seen[at].append(x[y == 0])
            fitted.append(_fitted(x[y == 1], clean_seen[at], len(y), marks))
        if machines is None:
            clean_seen = [[], [], []]  # whole documents serve the first machine only
        machines = fitted
    return Model(*machines[2], _link(labelled, machines))


def _fitted(plus: np.ndarray, minus: list[np.ndarray], docs: int, marks: Landmarks) -> tuple[np.ndarray, float]:
    """A machine folded into weights of letter triples, and its constant; both labels weigh the same."""
    clean = sum(map(len, minus))
    if not len(plus) or not clean:
        return np.zeros(LETTERS**3, np.float32), -1.0
    y = np.concatenate([np.ones(len(plus)), -np.ones(clean)])
    weight = np.concatenate([np.full(len(plus), len(y) / 2 / len(plus)), np.full(clean, len(y) / 2 / clean)])
    w = _machine(np.concatenate([plus, *minus]), y, weight, PENALTY * float(np.sqrt(docs)))
    return marks.fold(w[:-1]), float(w[-1])


def _link(labelled: DataFrame, machines: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The logistic link, fitted on what each half's machine says of the other half."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [Values(machines[half][0]) for half in (0, 1)]
        for b in _small(batches):
            halves = b.column(3).to_pylist()
            rows: list[list[float]] = [[]] * len(halves)
            for half in (0, 1):
                where = [i for i, h in enumerate(halves) if h == half]
                said = described(values[1 - half].of([sentences(b.column(0)[i].as_py()) for i in where]), machines[1 - half][1])
                for i, x in zip(where, said.tolist(), strict=True):
                    rows[i] = x
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "h", "x"])

    rows = sorted(labelled.select("text", "toxic", "h", "half").mapInArrow(gives_back(judged), "toxic int, h long, x array<double>").collect(), key=lambda r: (r["h"], r["x"]))  # ``limit`` short rows
    return _logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))


_last: list[Model] = []


def _remembering(model: Model) -> Model:
    """The model's copy that a worker's tasks share, so that they know each other's pieces; it goes when another model comes."""
    if not _last or _last[0] is not model:
        _last[:] = [model, Model(model.weights, model.bias, model.link)]
    return _last[1]


def scorer(spark: SparkSession, model: Model) -> object:
    """A column function from text to score; the model (about 1 MB) travels as a broadcast of fixed size."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _remembering(shared.value)
        for s in batches:
            parts = [own.score(list(s.iloc[i : i + 256])) for i in range(0, len(s), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    given = gives_back(score)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from given(batches)

    return scored


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity``, between 0 and 1; a column of that name is replaced."""
    return docs.withColumn("toxicity", scorer(docs.sparkSession, model)(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.5 or more, whole rows."""
    scored = docs.select(packed(docs), scorer(docs.sparkSession, train(docs, labels))(F.col("text")).alias("score"))
    return scored.where("score < 0.5").select("row.*")
