"""Reply trees: paths against plain Python, ranking, escaping and odd rows."""

from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from latticework.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "<|", "\\", "<\\s>", "[\\INST]", "<", "[", "\n", "a", "é", "", "<\\\\|"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "odd\nrole\\n", "<|x"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=6))
def test_template_is_reversible(turns: list[tuple[str, str]]) -> None:
    text, starts, ends = chat.render(turns)
    assert chat.parse(text) == turns
    assert chat.masked_text(text, starts, ends) == "".join(t for r, t in turns if r == "assistant")
    assert text.count(chat.OPEN) == text.count(chat.CLOSE) == len(turns) and text.count(chat.END) == 1


def paths_of(nodes: list[tuple]) -> dict[tuple, list]:
    known = {(t, n): (p, s) for t, n, p, s in nodes}
    parents = {(t, p) for t, n, p, s in nodes}
    out = {}
    for t, n, _, _ in nodes:
        if (t, n) not in parents:
            at, path, seen = n, [], set()
            while at is not None and (t, at) in known and at not in seen:
                seen.add(at)
                path.append(at)
                at = known[(t, at)][0]
            out[(t, n)] = path
    return out


def test_paths_and_ranks(spark: SparkSession) -> None:
    rng = random.Random(3)
    nodes = [(t, i, rng.randrange(i) if i and rng.random() > 0.1 else None, rng.random()) for t in ("a", "b") for i in range(40)]
    nodes += [("c", i, i - 1 if i else None, 1.0) for i in range(70)] + [("d", 5, 99, 0.5)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got: dict[tuple, list] = {}
    for r in chat.enumerate_paths(df).collect():
        got.setdefault((r["tree"], r["leaf"]), []).append((r["up"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == paths_of(nodes)
    score = {(t, n): s for t, n, _, s in nodes}
    best: dict[str, list] = {}
    for (t, leaf), path in paths_of(nodes).items():
        best.setdefault(t, []).append((-round(sum(score[t, n] for n in path), 9), leaf))
    for branches in (1, 3):
        top = {(r["tree"], r["leaf"], r["rank"]) for r in chat.enumerate_paths(df, branches).collect()}
        assert top == {(t, leaf, i + 1) for t, x in best.items() for i, (_, leaf) in enumerate(sorted(x)[:branches])}


def test_cycles_orphans_and_nulls(spark: SparkSession) -> None:
    nodes = [("x", 1, 2, 0.0), ("x", 2, 1, 0.0), ("x", 3, 2, 0.0), ("y", 7, 100, None), ("y", 8, 7, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    paths = chat.enumerate_paths(df)
    assert {(r["tree"], r["leaf"], r["node"]) for r in paths.collect()} == {("y", 8, 8), ("y", 8, 7)}
    turns = spark.createDataFrame([("y", 7, None, None), ("y", 8, "assistant", "hi")], "tree string, node long, role string, text string")
    row = chat.format_paths(paths, turns).first()
    assert chat.parse(row["formatted"]) == [("", ""), ("assistant", "hi")]
    assert chat.enumerate_paths(df.limit(0)).collect() == []
    assert chat.format_paths(chat.enumerate_paths(df.limit(0)), turns).collect() == []
