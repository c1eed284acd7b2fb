"""Line rules against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from latticework.llm import queries
from latticework.llm.line_quality import line_frequency_verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows: list[tuple], share: float, least: int) -> list[tuple]:
    norm = lambda line: " ".join(WORD.findall(line.lower()))
    texts, held = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                held[host, norm(line)].add(text or "")
    frequent = {k for k, v in held.items() if len(v) > least and len(v) > share * len(texts[k[0]])}
    out = []
    for doc_id, text, host in rows:
        t = text or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        gone = sum(len(WORD.findall(x)) for x in lines if (host, norm(x)) in frequent)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), gone, failed, not failed and gone <= 0.8 * len(words) and len(words) - gone >= 20))
    return out


def test_against_brute_force(spark: SparkSession) -> None:
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(40)]
    boiler = "Cookies  ARE used on this page to make it better for you and for all of us who work here today"
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(rng.randrange(6))]
        lines += [lines[0]] * (rng.random() < 0.3) if lines else []
        lines += [boiler if rng.random() < 0.5 else boiler.lower()] * (rng.random() < 0.7)
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "a", "b", None])))
    rows += [(500, None, "a"), (501, "", None), (502, " \t\n\x0b", "b"), (503, "x#*$%&|<>é " * 30, "b"), (504, "one two three four five six seven eight " * 4000, "a"), (505, f"{boiler}\n{boiler}", "a"), (None, boiler, "a")]
    rows += rows[:3] + [(600 + i, rows[5][1], "b") for i in range(30)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, n_words int, lines string")
    got = line_frequency_verdicts(docs, max_share=0.05, min_docs=8, carry=("text",)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")
    key = lambda r: tuple((x is None, x) if not isinstance(x, bool) else (False, int(x)) for x in r)
    want = brute(rows, 0.05, 8)
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want, key=key)
    assert any(r[6] for r in want) and any(not r[8] and not r[7] for r in want)
    cleaned = next(r for r in got if r["n_removed_words"] and r["kept"])
    assert "cookies" not in cleaned["clean_text"].lower() and "cookies" in cleaned["text"].lower()
    assert line_frequency_verdicts(docs.limit(0)).collect() == []


def test_carried_columns_of_any_name(spark: SparkSession) -> None:
    text = "one line of a text\n" * 9
    docs = spark.createDataFrame([(1, text, "s", 7, "l", "c")], "doc_id long, text string, source string, n_words int, lines string, _carry string")
    got = line_frequency_verdicts(docs, carry=("text", "n_words", "lines", "_carry", "source")).first().asDict()
    assert (got["n_words"], got["lines"], got["_carry"], got["clean_text"], got["source"]) == (45, "l", "c", text, "s")


def test_limits_act_on_small_hosts(spark: SparkSession) -> None:
    """With the limits of production: a notice in 4 of 10 texts goes, one in 3 stays, and what is left counts."""
    notice, rare = "all rights reserved by the owners of this page", "seldom seen line"
    own = lambda i, n: " ".join(f"t{i}w{j}" for j in range(n))
    texts = [f"{own(i, (40, 19, 20, 12)[i])}\n{notice}" for i in range(4)] + [f"{own(i, 30)}\n{rare}" for i in range(4, 7)] + [own(i, 25) for i in range(7, 10)]
    docs = spark.createDataFrame([(i, t, "small") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_removed_words"], r["base_failed"], r["kept"]) for r in line_frequency_verdicts(docs).collect()}
    assert [got[i] for i in range(4)] == [(9, False, True), (9, False, False), (9, False, True), (9, False, False)]
    assert all(got[i] == (0, False, True) for i in range(4, 10))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the test tables are not here")
def test_lines_change_verdicts_of_the_tables(spark: SparkSession) -> None:
    rows = queries.queries()["op5_line_quality"](spark, "/root/testdata/sf0.01").collect()
    assert any(r["kept"] == r["base_failed"] for r in rows)  # not failed by the base, and yet rejected
    assert not any(r["kept"] and r["base_failed"] for r in rows)
