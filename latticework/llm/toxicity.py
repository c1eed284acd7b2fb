"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Model (driver; bounded by ``max_examples`` labelled texts per class):

* Terms are words (lower case, outer punctuation off), all of them: every word of
  the labelled sample is a dimension with its weight ln(N / document frequency),
  none is selected by class or dropped. A word that the sample lacks is a
  dimension of its own with the weight of a frequency of one, shared with no
  example. A vector is sublinear TF times IDF, of length one.
* Examples lie in a block-max inverted index of blocks of ``BLOCK`` examples. A
  rare term adds its postings to a query's sums; a term that one example in
  ``COMMON`` holds has its postings as a row of numbers, and its largest weight in
  each block. What the rare terms gave and the block maxima of the common ones bound
  every cosine of a block. Blocks are opened best bound first, for all queries of a
  batch that they can still matter to, and no more once no bound reaches a query's
  k-th best cosine, so the k nearest are exact.
* A word is known by its 64-bit hash; among a million words two share one with odds
  of three in 10**8.
* A vote is the cosine-weighted share of toxic neighbours, shrunk towards the base
  rate. A text asks for the neighbours of itself as a whole (``k``), and of its
  shortest passages, its single words (``word_k``): one toxic word in a long clean
  text hardly turns the whole text's vector. A word's neighbours do not depend on
  the text, so their votes are made once, with the index.
* The score is a logistic curve over the whole text's vote, its ``TOP`` most toxic
  word votes and the number of its words, fitted to leave-one-out votes of the
  examples. Equal texts of the sample are one example, with their mean label, so
  none votes on its own copy.

The held-out rows take no part: not in the sample, the weights, the base rate or
the curve. Scoring is one narrow Arrow pass over whole texts with the model
broadcast; it holds the words of the sample, whatever the tables hold.

Null and empty texts, and texts without a word, get the base rate. Without labels
every score is 0.5. Repeated rows score alike, further columns are not read, an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.batches import small_batches
from latticework.llm.labelled import held_out, training_labels
from latticework.llm.scratch import materialize

BLOCK = 64
COMMON = 16
QUERIES = 64
TOP = 5
Vector = tuple[np.ndarray, np.ndarray]
"""Terms, and their weights."""

_OUTER = string.punctuation + "¡¿«»“”„…"


def terms(text: str) -> Counter:
    """Counts of a text's words."""
    found = Counter([run.strip(_OUTER) for run in text.lower().split()])
    found.pop("", None)
    return found


def hashes(words: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Index:
    """Block-max inverted index of unit vectors.

    Postings ``rows`` and ``weights`` lie in order of term and row, those of a term from
    ``first[term]`` to ``first[term + 1]``. The rows of numbers of the common terms, and their
    largest weights by block, are made from these where the index is used.
    """

    def __init__(self, n: int, rows: np.ndarray, weights: np.ndarray, first: np.ndarray):
        self.n, self.rows, self.weights, self.first = n, rows, weights, first
        self.at = np.full(len(first) - 1, -1, np.int32)  # a common term's row of numbers
        common = np.flatnonzero(np.diff(first) * COMMON > max(n, COMMON))
        self.at[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), -(-n // BLOCK) * BLOCK))
        for at, term in enumerate(common.tolist()):
            own = self.postings(term)
            self.dense[at, rows[own]] = weights[own]
        self.largest = self.dense.reshape(len(common), -1, BLOCK).max(2, initial=0)

    def __reduce__(self) -> tuple:
        return Index, (self.n, self.rows, self.weights, self.first)

    @classmethod
    def build(cls, vectors: list[Vector], n_terms: int) -> Index:
        term, weights = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
        rows = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        order = np.lexsort((rows, term))
        return cls(len(vectors), rows[order].astype(np.int32), weights[order], np.searchsorted(term[order], np.arange(n_terms + 1)))

    def postings(self, term: int) -> slice:
        return slice(self.first[term], self.first[term + 1])

    def _sums(self, queries: list[Vector]) -> tuple[np.ndarray, np.ndarray]:
        """Per query the sums over rare terms, and the weights of the common ones."""
        m, width = len(queries), self.dense.shape[1]
        number = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        row = self.at[terms]
        asked = np.zeros((m, len(self.dense)))
        asked[number[row >= 0], row[row >= 0]] = weights[row >= 0]
        number, terms, weights = number[row < 0], terms[row < 0], weights[row < 0]
        begin, end = self.first[terms], self.first[terms + 1]
        where, size = _ranges(begin, end), end - begin
        place = np.repeat(number * width, size) + self.rows[where]
        return np.bincount(place, np.repeat(weights, size) * self.weights[where], m * width).reshape(m, width), asked

    def nearest_of(self, queries: list[Vector], k: int, skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Per query the (cosine, row) of its k best rows with a positive cosine, ties to the smaller row; row ``skip[i]`` is left out."""
        if not queries or not self.n:
            return [[] for _ in queries]
        sums, asked = self._sums(queries)
        m, blocks = len(queries), sums.shape[1] // BLOCK
        bounds = sums.reshape(m, blocks, BLOCK).max(2) + asked @ self.largest.reshape(-1, blocks)
        best, opened = np.zeros((m, k)), np.zeros(sums.shape, bool)
        for b in np.argsort(-bounds.max(0), kind="stable").tolist():
            need = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] * (1 + 1e-12) >= best[:, 0]))
            if not len(need):
                continue
            inside = slice(b * BLOCK, (b + 1) * BLOCK)
            found = sums[need, inside] + asked[need] @ self.dense[:, inside]
            if skip is not None:
                for i, q in enumerate(need.tolist()):
                    if inside.start <= skip[q] < inside.stop:
                        found[i, skip[q] - inside.start] = 0
            sums[need, inside], opened[need, inside] = found, True
            both = np.concatenate([best[need], found], 1)
            both.partition(BLOCK, 1)
            best[need] = both[:, BLOCK:]
            best[need, 0] = both[:, BLOCK]
        sums[~opened] = 0
        out = []
        for own, reached in zip(sums, best[:, 0], strict=True):
            rows = np.flatnonzero(own >= max(reached * (1 - 1e-12), 1e-300))
            ranked = sorted((-round(float(own[r]), 12), int(r)) for r in rows)[:k]
            out.append([(-s, r) for s, r in ranked])
        return out

def _odds(share: float) -> float:
    return math.log((share + 0.01) / (1.01 - share))


@dataclass
class Model:
    words: np.ndarray | None = None  # hashes of the vocabulary in order; a word's number is its place
    idf: np.ndarray | None = None
    index: Index | None = None
    ids: list[int] = field(default_factory=list)
    toxic: np.ndarray | None = None
    word_votes: np.ndarray | None = None
    base: float = 0.5
    curve: tuple[float, ...] = ()
    k: int = 20
    word_k: int = 30
    shrink: float = 0.3

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 where the sample lacks a word."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def vector(self, numbers: np.ndarray, counts: np.ndarray) -> Vector:
        """Terms and weights of a unit TF-IDF vector; words outside the vocabulary only lengthen it."""
        tf = 1 + np.log(counts)
        weights = tf * np.where(numbers >= 0, self.idf[numbers], math.log(max(2, len(self.ids))))
        norm = math.sqrt(float(weights @ weights))
        used = (numbers >= 0) & (weights > 0)
        return numbers[used], weights[used] / norm if norm else weights[used]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The toxic share of the cosine-weighted votes, shrunk towards the base rate."""
        toxic = sum(s * self.toxic[r] for s, r in near)
        return float((toxic + self.shrink * self.base) / (sum(s for s, _ in near) + self.shrink))

    def votes(self, words: np.ndarray, near: list[tuple[float, int]], n_words: int) -> list[float]:
        """What the curve reads: one, the log odds of the most toxic word votes and of the whole text's, and the text's size."""
        best = np.sort(words)[: -TOP - 1 : -1].tolist()
        return [1.0, *map(_odds, [*best, *[self.base] * (TOP - len(best))]), _odds(self.vote(near)), math.log(1 + n_words)]

    def calibrated(self, votes: list[float]) -> float:
        margin = sum(w * v for w, v in zip(self.curve, votes, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, margin))))

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[float, int]], list[tuple[str, int]]]]:
        """Per text its calibrated score and the evidence: (cosine, row) neighbours of the whole text, and the most toxic words with their numbers."""
        if not self.curve:
            return [(self.base, [], [])] * len(texts)
        out = []
        for at in range(0, len(texts), QUERIES):
            counted = [terms(text) for text in texts[at : at + QUERIES]]
            numbered = [self.numbers(hashes(counts)) for counts in counted]
            near_of = self.index.nearest_of([self.vector(own, np.fromiter(counts.values(), float, len(counts))) for own, counts in zip(numbered, counted, strict=True)], self.k)
            for counts, numbers, near in zip(counted, numbered, near_of, strict=True):
                known = np.flatnonzero(numbers >= 0)
                votes = self.word_votes[numbers[known]]
                words = list(counts)
                best = [(words[known[i]], int(numbers[known[i]])) for i in np.argsort(-votes, kind="stable")[:TOP]]
                out.append((self.calibrated(self.votes(votes, near, len(counts))) if counts else self.base, near, best))
        return out


def _word_votes(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The vote of each word's nearest examples, and for each posting that vote without the posting's own example."""
    index, k = model.index, model.word_k
    n_terms, per_term = len(model.words), np.diff(index.first)
    term = np.repeat(np.arange(n_terms), per_term)
    # a word's neighbours in order: falling cosine, which is the weight there, ties to the smaller row
    order = np.lexsort((index.rows, -index.weights, term))
    rank = np.arange(len(term)) - np.repeat(np.cumsum(per_term) - per_term, per_term)
    cosine, toxic = index.weights[order], model.toxic[index.rows[order]]

    def sums(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(term[of], cosine[of], n_terms), np.bincount(term[of], (cosine * toxic)[of], n_terms)

    (total, bad), (next_total, next_bad) = sums(rank < k), sums(rank == k)
    share = lambda a, b: (a + model.shrink * model.base) / (b + model.shrink)
    # without one of the k nearest, the one after them takes part
    own = rank < k
    less = np.where(own, next_total[term] - cosine, 0) + total[term]
    less_bad = np.where(own, next_bad[term] - cosine * toxic, 0) + bad[term]
    without = np.empty(len(term))
    without[order] = share(less_bad, less)
    return share(bad, total), without


def _fit_curve(votes: np.ndarray, y: np.ndarray, base: float, steps: int = 100) -> tuple[float, ...]:
    """Weights of a logistic curve over votes by Newton steps with line search; classes weigh as ``base`` has them."""
    weight = np.where(y > 0, base / max(1.0, y.sum()), (1 - base) / max(1.0, (1 - y).sum())) * len(y)
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, ridge = np.where(y > 0, high, low), 1e-2

    def loss(w: np.ndarray) -> float:
        margin = votes @ w
        return float(weight @ (np.logaddexp(0, margin) - target * margin) + ridge / 2 * w @ w)

    w = np.zeros(votes.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(votes @ w, -40, 40)))
        gradient = votes.T @ (weight * (p - target)) + ridge * w
        hessian = (votes * (weight * p * (1 - p))[:, None]).T @ votes + ridge * np.eye(len(w))
        step, size, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * (gradient @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return tuple(map(float, w))


def build_model(examples: list[tuple[int, float, np.ndarray, np.ndarray]], base: float) -> Model:
    """A model of (id, label, hashes of the words in order, their counts) examples."""
    alike: dict[tuple[bytes, bytes], list[tuple]] = {}
    for example in examples:
        alike.setdefault((example[2].tobytes(), example[3].tobytes()), []).append(example)
    one = [(min(e[0] for e in own), sum(e[1] for e in own) / len(own), *own[0][2:]) for own in alike.values()]
    model = Model(base=base, ids=[e[0] for e in one])
    model.words, df = np.unique(np.concatenate([e[2] for e in one]), return_counts=True)
    if not len(df):
        return model
    model.idf = np.log(len(one) / df)
    made = [(*model.vector(model.numbers(words), counts), i, y, len(words)) for i, y, words, counts in one]
    # alike examples side by side make tight block bounds
    made.sort(key=lambda v: (int(v[0][np.argmax(v[1])]) if len(v[0]) else -1, v[2]))
    model.ids, model.toxic = [v[2] for v in made], np.array([v[3] for v in made])
    model.index = Index.build([v[:2] for v in made], len(df))
    model.word_votes, without = _word_votes(model)
    by_row = np.argsort(model.index.rows, kind="stable")
    ends = np.cumsum(np.bincount(model.index.rows, minlength=len(made)))
    votes = []
    for at in range(0, len(made), QUERIES):
        near_of = model.index.nearest_of([v[:2] for v in made[at : at + QUERIES]], model.k, list(range(at, min(at + QUERIES, len(made)))))
        for row, near in enumerate(near_of, at):
            own = by_row[ends[row - 1] if row else 0 : ends[row]]
            votes.append(model.votes(without[own], near, made[row][4]))
    model.curve = _fit_curve(np.array(votes), (model.toxic >= 0.5).astype(float), min(max(base, 0.001), 0.999))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_examples: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_examples`` labelled documents per class that are not held out."""
    chosen = F.broadcast(training_labels(labels, label_col, max_examples, per_class=True, id_col=id_col))
    found = docs.select(id_col, text_col).join(chosen, id_col).groupBy(id_col, "y").agg(F.min(text_col).alias("t"))
    kinds = {"words": T.ArrayType(T.LongType()), "counts": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("y", T.DoubleType()), *[T.StructField(n, t) for n, t in kinds.items()]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, numbers = [], []
            for text in batch.column(2).to_pylist():
                found = terms(text or "")
                own, order = np.unique(hashes(found), return_index=True)
                words.append(own.view(np.int64))
                numbers.append(np.fromiter(found.values(), np.int32, len(found))[order])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32()))], names=schema.names)

    sample = materialize(found.mapInArrow(count, schema), "toxic-sample").orderBy(id_col).toArrow()
    examples = [
        (i.as_py(), y.as_py(), words.values.to_numpy().view(np.uint64), counts.values.to_numpy().astype(float))
        for i, y, words, counts in zip(*[sample.column(c) for c in schema.names], strict=True)
    ]
    if not examples:
        return Model()
    usable = F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)
    share = labels.where(usable).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    return build_model(examples, float(share or 0.0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """(id_col, score, evidence) per row.

    Evidence is an array of (word, doc_id, toxic, cosine): for the most toxic words
    the nearest example of each, then, with a null word, those nearest to the whole text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = [("word", T.StringType()), ("doc_id", T.LongType()), ("toxic", T.IntegerType()), ("cosine", T.DoubleType())]
    proof = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in parts]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("evidence", proof)])
    names = schema.names
    kind = pa.list_(pa.struct([("word", pa.string()), ("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def told(word: str | None, cosine: float, row: int) -> dict:
            return {"word": word, "doc_id": model.ids[row], "toxic": int(model.toxic[row] >= 0.5), "cosine": cosine}

        def nearest_to(word: str, at: int) -> list[dict]:
            own = model.index.postings(at)
            best = int(np.argmax(model.index.weights[own])) + own.start
            return [told(word, float(model.index.weights[best]), int(model.index.rows[best]))]

        for batch in small_batches(batches):
            scores, proofs = [], []
            for value, near, words in model.scores([text or "" for text in batch.column(1).to_pylist()]):
                scores.append(value)
                proofs.append([e for w, at in words[:evidence] if model.idf[at] > 0 for e in nearest_to(w, at)] + [told(None, s, r) for s, r in near[:evidence]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(proofs, kind)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
