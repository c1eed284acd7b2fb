"""The pipeline on the smallest tables, and its decisions against the operators'."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import SparkSession

pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_stages(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, str(DATA)), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        assert all(len(r["text"]) == r["n_chars"] for r in rows)
        ids.append({r["doc_id"] for r in rows})
        assert ids[-1] <= ids[-2] and len(rows) == len(ids[-1])
        if name == "near_dedup":
            texts = [r["text"] for r in rows]
            assert not any(jaccard(a, b) >= 0.8 for i, a in enumerate(texts) for b in texts[i + 1 :] if abs(len(a) - len(b)) < 0.3 * max(len(a), len(b)))
    packed = pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert {r["doc_id"] for r in packed} == ids[-1]


def test_run_is_the_stages(spark: SparkSession) -> None:
    assert pipeline.run(spark, str(DATA)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_further_columns_pass(spark: SparkSession) -> None:
    rows = [(i, f"line {i} of many words that say nothing much at all but fill the twenty words a text needs to stay {i}\nend", "en", "s", 5, "x", 0.5, 1) for i in range(30)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, _row string, score double, n_card int")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, str(DATA)), "test-further")
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", "_row", "score", "n_card"}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark: SparkSession, tmp_path: Path) -> None:
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.collect() == []
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_ties_and_repeated_rows(spark: SparkSession, tmp_path: Path) -> None:
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (3, text, "de", None, 1), (None, text, None, None, None), (2, None, None, "a", None), (2, "", "en", "a", 0), (9, f"{text} mail a1@b.org", "en", "a", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    of = {name: [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in pipeline.STAGES}
    assert sorted(r[0] or 0 for r in of["quality_rules"]) == [0, 3, 3, 3, 9]
    assert len(of["quality_classifier"]) == len(rows)  # without labels every score is 0.5
    # one of the similar texts with the smallest id, one of those without a word
    assert sorted((r[0], r[1] or "") for r in of["near_dedup"]) == [(2, ""), (3, text)]
    again = [tuple(r) for r in pipeline.STAGES[2][1](spark, docs.repartition(3), str(tmp_path)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, of["near_dedup"]))
    assert len(of["pseudonyms"]) == len(rows) and all(r[4] == (None if r[1] is None else len(r[1])) for r in of["pseudonyms"])
    assert sum(r[3] for r in of["pack"]) >= 4 * 60 and len(of["pack"]) == len(rows)
