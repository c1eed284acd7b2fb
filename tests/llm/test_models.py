"""Quality rules and toxic neighbours: held-out accuracy, exactness, and tables without labels."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework.llm import queries, rules, toxicity
from latticework.llm.labelled import held_out, training_labels

DATA = Path("/root/testdata/sf0.01")


def test_held_out_rows(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").withColumn("h", held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert rows[-1]["h"] is False


def test_training_rows_are_bounded_and_known(spark: SparkSession) -> None:
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, 0), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    got = training_labels(labels, "toxic", 20, per_class=True).collect()
    assert len(got) == 40 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got)
    assert training_labels(labels, "toxic", 1000).where("doc_id = 1").count() <= 1


def test_rules_find_a_conjunction() -> None:
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(rules.STATISTICS)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.4)).astype(float)
    model = rules.fit(x[:2000], y[:2000])
    margin = model.intercept + sum(w * rules.holds(r, x[2000:]) for r, w in zip(model.rules, model.weights, strict=True))
    assert ((margin > 0) == (y[2000:] > 0)).mean() > 0.97
    assert 0 < len(model.rules) < 60 and len(model.describe()) == len(model.rules)


def test_compiled_score_is_the_model(spark: SparkSession) -> None:
    rng = np.random.default_rng(2)
    x = rng.random((200, len(rules.STATISTICS)))
    model = rules.RuleModel(-0.3, (((0, 0.5, np.inf),), ((1, -np.inf, 0.4), (2, 0.1, 0.9))), (1.5, -2.0))
    frame = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in rules.STATISTICS))
    got = [r[0] for r in frame.select(rules.compile_score(model)).collect()]
    margin = model.intercept + sum(w * rules.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize(("name", "label", "least"), [("op6_rule_ensemble", "quality", 0.97), ("op9_nearest_toxic", "toxic", 0.95)])
def test_held_out_accuracy(spark: SparkSession, name: str, label: str, least: float) -> None:
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.queries()[name](spark, str(DATA))
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


def test_odd_rows_and_missing_labels(spark: SparkSession) -> None:
    rows = [(1, "plain words here."), (1, "plain words here."), (2, None), (3, ""), (None, "x"), (4, "w " * 300_000)]
    docs = spark.createDataFrame([(*r, 0.5, "e") for r in rows], "doc_id long, text string, score double, y string")
    for labels in (spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(2, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")):
        quality = rules.score(docs, rules.train(docs, labels)).collect()
        toxic = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        for scored in (quality, toxic):
            assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert rules.score(docs.limit(0), rules.RuleModel(0.0)).collect() == []
    assert toxicity.score(docs.limit(0), toxicity.Model()).collect() == []


def test_nearest_is_exact() -> None:
    rng = random.Random(9)

    def unit() -> dict[int, float]:
        raw = {t: rng.choice((0.5, 1.0, 2.0)) for t in rng.sample(range(60), rng.randrange(0, 6))}
        norm = sum(w * w for w in raw.values()) ** 0.5
        return {t: w / norm for t, w in raw.items()}

    arrays = lambda v: (np.array(list(v), np.int64), np.array(list(v.values()), float))
    vectors = sorted((unit() for _ in range(400)), key=lambda v: min(v, default=-1))
    index = toxicity.Index.build([arrays(v) for v in vectors], 60)
    assert 0 < len(index.dense) < 60  # some terms are common, some rare
    for _ in range(150):
        query, skip = unit(), rng.choice((-1, rng.randrange(400)))
        scores = [(-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors) if i != skip]
        want = sorted(s for s in scores if s[0] < 0)[:10]
        got = [(-s, r) for s, r in index.nearest_of([arrays(query)], 10, [skip])[0]]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
        assert [r for _, r in got] == [r for _, r in want]


def test_toxic_words_are_found_with_evidence(spark: SparkSession) -> None:
    rng = random.Random(4)
    pool = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = rng.choices(pool, k=60)
        if i % 4 == 0:
            for at in rng.sample(range(60), 4):
                words[at] = rng.choice(("Grobian!", "schurke,", "lump"))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).withColumn("h", held_out()).where("h").collect()}
    assert all((got[i]["score"] >= 0.7) == bool(y) for i, _, y in rows if i in got)
    assert all(e["toxic"] == 1 and e["cosine"] > 0 for i, _, y in rows if i in got and y for e in got[i]["evidence"][:1])
