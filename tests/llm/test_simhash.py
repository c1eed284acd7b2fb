"""SimHash components and similar groups against brute force."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework.llm import simhash
from latticework.llm.components import connected_components


def brute_fingerprint(text: str | None, width: int) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys: list, linked) -> dict:  # noqa: ANN001
    parent = {k: k for k in keys}

    def find(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("width", [1, 3, 5])
def test_fingerprint(width: int) -> None:
    rng = random.Random(width)
    texts = ["", " \t\n", None, "One", "a b", "É é A", "x" * 5000, "a b c " * 30_000]
    texts += [" ".join(rng.choice("ab cd EF gh ñ".split()) for _ in range(rng.randrange(60))) for _ in range(30)]
    for text in texts:
        got = simhash.simhash(simhash.shingle_hashes(None if text is None else text.encode(), width))
        assert got % (1 << 64) == brute_fingerprint(text[:20_000] if text and len(text) < 100_000 else text, width)


@pytest.mark.parametrize("limit", [1, 3, 128])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_have_the_components_of_all_links(spark: SparkSession, max_bits: int, limit: int) -> None:
    rng = random.Random(limit)
    bases = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = set(bases)
    for base in bases[:4]:
        for _ in range(25):
            value = base
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                value ^= 1 << bit
            fps.add(value)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = connected_components(simhash.links(rows, max_bits, bucket_limit=limit)).collect()
    got = {f: f for f in signed} | {r["node"]: r["component"] for r in found}
    want = brute_components(sorted(signed), lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= max_bits)
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert classes(got) == classes(want)


def test_components_of_documents(spark: SparkSession) -> None:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(words, k=150)) for _ in range(8)]
    rows = [(i, t, "x") for i, t in enumerate(base)] + [(10 + i, t.upper(), "y") for i, t in enumerate(base[:4])]
    rows += [(20 + i, t + " end", None) for i, t in enumerate(base)] + [(30, "", "e"), (31, None, "e"), (None, base[7], "n"), (32, "lone words", "z"), (32, "lone words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicate_components(docs).collect()
    assert len(got) == len(rows)
    fp = {r["doc_id"]: r["fp"] for r in got}
    ids = sorted(i for i in fp if i is not None)
    want = brute_components(ids[::-1], lambda a, b: bin((fp[a] ^ fp[b]) % (1 << 64)).count("1") <= 2)
    least = {i: min(j for j in ids if want[j] == want[i]) for i in ids}
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == least
    assert next(r["component_id"] for r in got if r["doc_id"] is None) == least[7]
    assert fp[30] == fp[31] == 0
    assert simhash.near_duplicate_components(docs.limit(0)).collect() == []


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_one_of_each_group_stays(spark: SparkSession) -> None:
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.choice((30, 120, 400)))) for _ in range(40)]

    def edited(text: str, n: int) -> str:
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    for t in texts[:25]:
        texts += [edited(t, 1), edited(t, 2), edited(t, len(t.split()) // 5)]
    texts += [edited(texts[0], 3) for _ in range(40)] + texts[:5] + ["", None, "", "short one"]
    rows = [(1000 - i, t, "a", 1) for i, t in enumerate(texts)] + [(1000, texts[0], "a", 1), (None, "no id at all here", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, least int")
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    names = sorted({t or "" for t in texts})
    group = brute_components(names, lambda a, b: jaccard(a.lower(), b.lower()) >= 0.8)
    smallest: dict[str, int] = {}
    for i, t, *_ in rows[:-2]:
        g = group[t or ""]
        smallest[g] = min(smallest.get(g, 10**9), i)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(smallest.values())
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.keep_one_of_each_group(docs.limit(0)).collect() == []


def spoiled(words: list[str], own: str, n: int, rng: random.Random) -> str:
    """The words with ``n`` of them, five or more apart, replaced by new ones."""
    out = list(words)
    for at in rng.sample(range(len(words) // 5), n):
        out[5 * at] = f"{own}x{at}"
    return " ".join(out)


def test_copies_alike_only_through_their_original(spark: SparkSession) -> None:
    rng = random.Random(7)
    star = [f"w{i}" for i in range(1000)]
    copies = [spoiled(star, f"c{i}", 18, rng) for i in range(300)]
    assert all(jaccard(c, " ".join(star)) >= 0.8 for c in copies[:50]) and max(jaccard(copies[0], c) for c in copies[1:50]) < 0.8
    # a crowded bucket of texts that are not similar at all stays as it is
    common = [f"p{i}" for i in range(120)]
    others = [" ".join([*common, *(f"o{k}y{i}" for i in range(120))]) for k in range(60)]
    texts = [*copies, " ".join(star), *others]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each_group(docs).collect()) == [0, *range(301, 361)]


def test_variants_of_variants_are_one_group(spark: SparkSession) -> None:
    """400 texts of one bucket after the other, most of them alike to their neighbours in the chain only."""
    rng = random.Random(23)
    words, texts = [f"w{i}" for i in range(220)], []
    for k in range(400):
        for at in rng.sample(range(44), 3):
            words[5 * at] = f"v{k}x{at}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(400) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 399 <= len(near) < 2000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one_of_each_group(docs).collect()] == [0]


def test_copies_that_repeat_a_line(spark: SparkSession) -> None:
    rng = random.Random(9)
    texts = []
    for k in range(12):
        words, line = [f"t{k}w{i}" for i in range(1000)], " ".join(f"t{k}l{i}" for i in range(9))
        texts += ["\n".join([" ".join(words), *[line] * n]) for n in (1, 40)]
    assert all(jaccard(a, b) > 0.98 for a, b in zip(texts[::2], texts[1::2], strict=True))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one_of_each_group(docs).count() == 12


@pytest.mark.parametrize("block", [3, 128])
def test_all_pairs_of_a_bucket(spark: SparkSession, block: int) -> None:
    rng = random.Random(block)
    sets = {f"n{i:02d}": sorted(rng.sample(range(24), rng.randrange(12, 24))) for i in range(40)}
    rows = [(0, 7, n, n if i % 4 else "n00") for i, n in enumerate(sets)]
    group = {r[2]: r[3] for r in rows}
    near = lambda a, b: group[a] == group[b] or len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    crowded = spark.createDataFrame(rows, "band int, key long, node string, g string")
    known = crowded.select("node", F.col("g").alias("group"))
    apart = simhash._unsettled(crowded.drop("g"), known)
    found = simhash._merged(known, simhash._all_pairs(apart, spark.createDataFrame(list(sets.items()), "node string, shingles array<int>"), 0.8, block))
    got, want = {r["node"]: r["group"] for r in found.collect()}, brute_components(list(sets), near)
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert got.keys() == want.keys() and classes(got) == classes(want) and len(classes(want)) > 2


def test_components_of_a_path_and_loops(spark: SparkSession) -> None:
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 199), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**dict.fromkeys(range(61), 0), 100: 100, 200: 199, 199: 199}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_hex_has_sixteen_digits(spark: SparkSession) -> None:
    row = spark.createDataFrame([(5, -1)], "a long, b long").select(simhash.hex_fingerprint(F.col("a")), simhash.hex_fingerprint(F.col("b"))).first()
    assert tuple(row) == ("0000000000000005", "f" * 16)


def test_similar_groups_begin_with_links_of_fingerprints(spark: SparkSession) -> None:
    fps = spark.createDataFrame([("a", 0), ("b", 0), ("c", 3), ("d", 7), ("e", -1), ("f", 1 << 40)], "node string, fp long")
    # c is two bits from 0 and one from d, f one bit from 0 and three from c
    assert {tuple(r) for r in simhash.fingerprint_pairs(fps).collect()} == {("b", "a"), ("c", "a"), ("d", "c"), ("f", "a")}
    text = " ".join(f"word{i}" for i in range(400))
    # texts without a word have no sketch: only their fingerprints link them
    rows = [(1, text), (2, f"{text} more"), (3, ""), (4, " "), (5, "\n\t"), (6, None), (7, "another one")]
    kept = simhash.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7]
