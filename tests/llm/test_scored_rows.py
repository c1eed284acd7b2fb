"""The scored rows of op6 and op9 on the smallest tables, computed again from the texts in plain Python."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework.llm import queries, rules, toxicity

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def texts() -> dict[int, str]:
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def labelled(texts: dict[int, str]) -> list[tuple[int, int, int]]:
    return [r for r in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{DATA}/labels.parquet' ORDER BY 1").fetchall() if r[0] in texts and not held(r[0])]


def words_of(text: str) -> Counter:
    stripped = (w.strip(string.punctuation + "¡¿«»“”„…") for w in text.lower().split())
    return Counter(w for w in stripped if w)


def test_toxicity_rows(spark: SparkSession, texts: dict[int, str], labelled: list) -> None:
    known = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{DATA}/documents.parquet"), known)
    groups: dict[tuple, list] = {}
    for i, _, toxic in labelled:
        groups.setdefault(tuple(sorted(words_of(texts[i]).items())), []).append((i, toxic))
    examples = [(dict(words), min(own)[0], sum(y for _, y in own) / len(own)) for words, own in groups.items()]
    n = len(examples)
    df = Counter(w for words, _, _ in examples for w in words)
    assert model.words.tolist() == sorted(xxhash.xxh64_intdigest(w) for w in df)  # every word of the sample, none chosen by class
    base = sum(y for _, _, y in labelled) / len(labelled)
    assert model.base == pytest.approx(base)

    def vector(words: dict[str, int]) -> dict[str, float]:
        raw = {w: (1 + math.log(c)) * math.log(n / df.get(w, 1)) for w, c in words.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()} if norm else {}

    vectors = [(vector(words), i, y) for words, i, y in examples]

    def vote(query: dict[str, float], k: int, skip: int | None = None) -> float:
        near = [(sum(x * v.get(w, 0.0) for w, x in query.items()), y, i) for v, i, y in vectors if i != skip]
        near = sorted((x for x in near if x[0] > 1e-12), key=lambda x: -x[0])[:k]
        return (sum(s * y for s, y, _ in near) + model.shrink * base) / (sum(s for s, _, _ in near) + model.shrink)

    def features(words: dict[str, int], skip: int | None = None) -> list[float]:
        single = {w: [(v[w], y, i) for v, i, y in vectors if w in v and v[w] > 0 and i != skip] for w in words if w in df}
        of_word = []
        for near in single.values():
            best = sorted(near, key=lambda x: -x[0])[:30]
            of_word.append((sum(s * y for s, y, _ in best) + model.shrink * base) / (sum(s for s, _, _ in best) + model.shrink))
        top = sorted(of_word, reverse=True)[:5]
        odds = [math.log((p + 0.01) / (1.01 - p)) for p in [*top, *[base] * (5 - len(top)), vote(vector(words), 20, skip)]]
        return [1.0, *odds, math.log(1 + len(words))]

    for r in queries.queries()["op9_nearest_toxic"](spark, str(DATA)).collect():
        words = words_of(texts[r["doc_id"]])
        want = base if not words else 1 / (1 + math.exp(-float(np.dot(features(words), model.curve))))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.7)
    # the curve is where the penalised loss of the leave-one-out votes is flat
    x, y = np.array([features(words, i) for words, i, _ in examples]), np.array([y >= 0.5 for _, _, y in examples], float)
    weight = np.where(y > 0, base / y.sum(), (1 - base) / (1 - y).sum()) * n
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    curve = np.array(model.curve)
    gradient = x.T @ (weight * (1 / (1 + np.exp(-x @ curve)) - target)) + 0.01 * curve
    assert np.abs(gradient).max() < 1e-3


def test_held_out_labels_change_no_score(spark: SparkSession) -> None:
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    for module in (toxicity, rules):
        before, after = ({r["doc_id"]: r["score"] for r in module.score(docs, module.train(docs, of)).collect()} for of in (labels, flipped))
        assert before == after


_SPACE = re.compile("[\x20\x09-\x0d]+")


def measured(text: str) -> list[float]:
    words = [w for w in _SPACE.split(text) if w]
    lines, n, k = text.split("\n"), len(text), len(words)
    of = lambda a, b: a / b if b else 0.0
    symbols = set("#*$%&|<>")
    return [
        math.log1p(k), of(sum(map(len, words)), k), of(sum(c in symbols for c in text), n), of(len(re.findall("[A-ZÀ-ÖØ-Þ]", text)), n), of(len(re.findall("[0-9]", text)), n),
        of(text.count("!"), k), of(text.count("."), k), of(text.count(","), k), of(len(set(words)), k), of(k, len(lines)), of(len(set(lines)), len(lines)),
        of(sum(len(w) <= 2 for w in words), k), of(sum(len(w) > 14 for w in words), k), of(sum(bool(symbols & set(w)) for w in words), k),
    ]


def test_quality_rows(spark: SparkSession, texts: dict[int, str], labelled: list) -> None:
    model = rules.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    x = np.array([measured(texts[i]) for i, _, _ in labelled])
    order = np.random.default_rng(0).permutation(len(x))
    again = rules.fit(x[order], np.array([q for _, q, _ in labelled], float)[order])
    assert again.rules == model.rules and np.allclose(again.weights, model.weights) and again.intercept == pytest.approx(model.intercept)
    for r in queries.queries()["op6_rule_ensemble"](spark, str(DATA)).collect():
        m = measured(texts[r["doc_id"]])
        margin = model.intercept + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all(low < m[i] <= high for i, low, high in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5)
