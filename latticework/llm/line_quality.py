"""Quality rules over whole texts and over lines that documents of a host share. DataFrame functions only.

``text_statistics`` measures each text. ``line_frequency_verdicts`` counts, for
every host, the distinct documents that hold each normalised line, removes the
lines above the limits, and rejects documents that are depleted by it.

Definitions
-----------
* words: maximal runs of characters other than space and U+0009-U+000D.
* distinct documents of a host: distinct texts, so a text copied a thousand
  times counts once and cannot make its own lines look like boilerplate.
* a line is above the limits if it stands in more than ``max_share`` of the
  host's distinct documents and in more than ``min_docs`` of them. The share decides;
  ``min_docs`` only says how few documents prove nothing, so it is small and limits
  act on hosts of every size.
* a document is depleted if more than ``max_removed`` of its words were on
  removed lines, or if these lines leave it with fewer than ``min_words`` words,
  the number that its whole text must have.

Null text counts as empty, a null host is a host of its own, repeated rows get
a verdict each, and an empty table gives an empty result. Further columns are not read, except
those that ``carry`` names; where one is named like a column of the result, the result's wins.

Lines and texts are told by 64-bit hashes. A host of 100 million distinct lines has
two with one hash with odds of 1 in 3700; a document is then counted for the wrong one.

Scale: one narrow scan of the texts; only (host, line hash, text hash) triples
are shuffled. They are combined on the map side, first by triple and then by
(host, line), so a hot host or a hot line never meets in one task. The removed
lines of a host are at most (lines per document) / ``max_share``, a short array
that is joined by host; the plain equi-join can be split by AQE when one host
holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.scratch import materialize

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` places on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def _places(hashes: Column) -> Column:
    """(hash, place) structs in order of hash."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))


def _repeated_places(places: Column) -> Column:
    """Places, in order, whose hash stands at two or more. ``places`` must be a plain column."""
    again = F.filter(
        places, lambda x, j: (F.get(places, j - 1)["h"] == x["h"]) | (F.get(places, j + 1)["h"] == x["h"])
    )
    return F.array_sort(F.transform(again, lambda x: x["i"]))


def _union_length(starts: Column) -> Column:
    """Length of the union of windows at sorted ``starts``."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last"))
    step = F.aggregate(
        starts,
        zero,
        lambda acc, i: F.struct(
            (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"]).cast("long")).alias("total"), i.alias("last")
        ),
    )
    return step["total"]


def text_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines and text_hash.

    ``lines`` holds, per line with a word, the hash of the normalised line and its number of words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(*keep, text.alias("_t")).select(
        *keep,
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.xxhash64("_t", F.length("_t")).alias("text_hash"),
    )
    two = one.select(
        *keep,
        "n_symbols",
        "text_hash",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_l", line_key).alias("lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    three = two.withColumn("_h2", _pairs(F.col("_h1"), 1)).drop("_h1")
    four = three.withColumn("_h4", _pairs(F.col("_h2"), 2)).drop("_h2")
    # four words that never repeat rule out eight that do
    again = F.size("_h4") > F.size(F.array_distinct("_h4"))
    five = four.withColumn("_h8", F.when(again, _pairs(F.col("_h4"), 4))).drop("_h4")
    repeats = F.size("_h8") > F.size(F.array_distinct("_h8"))
    six = five.withColumn("_at", F.when(repeats, _places(F.col("_h8")))).drop("_h8")
    repeated = F.when(F.col("_at").isNotNull(), _union_length(_repeated_places(F.col("_at"))))
    return six.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("_at")


def line_key(line: Column) -> Column:
    parts = F.filter(F.split(F.lower(line), SPACE), lambda w: w != "")
    return F.struct(F.xxhash64(F.array_join(parts, " ")).alias("h"), F.size(parts).alias("n"))


def frequent_lines(stats: DataFrame, host_col: str, max_share: float, min_docs: int) -> DataFrame:
    """``(host, frequent array<long>)``: line hashes above the limits."""
    texts = stats.select(F.col(host_col).alias("host"), "text_hash", "lines")
    sizes = texts.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    held = (
        texts.select("host", "text_hash", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
        .distinct()
        .groupBy("host", "h")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > min_docs)
    )
    same = held["host"].eqNullSafe(sizes["host"])
    over = held.join(sizes, same).where(F.col("n") > max_share * F.col("n_docs")).select(held["host"], "h")
    return over.groupBy("host").agg(F.collect_list("h").alias("frequent"))


def line_frequency_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    carry: tuple[str, ...] = (),
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_share: float = 0.05,
    min_docs: int = 3,
    max_removed: float = 0.8,
) -> DataFrame:
    """One row per document: the statistics, base_failed, n_removed_words and kept.

    ``carry`` names columns to pass through; with the text among them the result
    also has clean_text, the text without the removed lines.
    """
    own = [F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text")]
    rows = docs.select(*own, F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry else F.lit(None).alias("_carry"))
    stats = materialize(text_statistics(rows, "_text", ("_id", "_host", "_carry")), "line-stats")
    frequent = materialize(frequent_lines(stats, "_host", max_share, min_docs), "line-frequent")
    joined = stats.join(frequent, stats["_host"].eqNullSafe(frequent["host"]), "left").drop("host")
    removed = F.aggregate(
        F.filter("lines", lambda x: F.array_contains(F.col("frequent"), x["h"])),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x["n"],
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    gone, left = F.col("n_removed_words"), F.col("n_words") - F.col("n_removed_words")
    depleted = (gone > max_removed * F.col("n_words")) | (left < min_words)
    judged = (
        joined.withColumn("n_removed_words", F.coalesce(removed, F.lit(0).cast("long")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )
    names = ["n_symbols", "text_hash", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]
    if text_col in carry:
        text = F.col("_carry")[text_col]
        left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("frequent"), line_key(x)["h"]))
        judged = judged.withColumn("clean_text", F.when(F.col("n_removed_words") > 0, F.array_join(left, "\n")).otherwise(text))
        names.append("clean_text")
    passed = [c for c in dict.fromkeys(carry) if c not in (id_col, host_col, *names)]
    return judged.select(F.col("_id").alias(id_col), F.col("_host").alias(host_col), *[F.col("_carry")[c].alias(c) for c in passed], *names)
