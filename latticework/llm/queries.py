"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered pseudonym query. A deployment passes its own secret.
DEMO_KEY = b"latticework demonstration key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.pii import KINDS, pseudonymize

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, DEMO_KEY).select("doc_id", "text", *[f"n_{k}" for k in KINDS])


def op2_chat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.chat import enumerate_paths, format_paths, masked_text, parse

    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # a conversation is a tree without branches: each turn replies to the one before
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = (
        rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
        .withColumn("node", F.row_number().over(order).cast("long"))
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
        .withColumn("score", F.lit(0.0))
    )
    made = format_paths(enumerate_paths(turns, branches=1), turns)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tree, text, starts, ends in zip(
                frame["tree"], frame["formatted"], frame["loss_starts"], frame["loss_ends"], strict=True
            ):
                turns = parse(text)
                loss = masked_text(text, starts, ends)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((None if tree == "none" else int(tree), len(turns), _sha256(told), len(loss), _sha256(loss), len(text)))
            yield pd.DataFrame(out, columns=_CHAT_COLUMNS, dtype=object)

    return made.mapInPandas(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_CHAT_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.simhash import hex_fingerprint, near_duplicate_components

    found = near_duplicate_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.scratch import delete_at_exit, fresh_path
    from latticework.llm.warc import page_records, read_archives, resolve_revisits, write_archives

    path = fresh_path(spark, "warc")
    write_archives(resolve_revisits(page_records(_table(spark, sf_dir, "pages"))), path)
    delete_at_exit(spark, path)
    back = read_archives(spark, path, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.line_quality import line_frequency_verdicts

    return line_frequency_verdicts(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.labelled import held_out
    from latticework.llm.rules import score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from latticework.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.topk import quantize, top_k

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", quantize(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "v", k=5)


def op9_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.labelled import held_out
    from latticework.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted, "evidence")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from latticework.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.prefix_trie import prefix_trie, sequences

    own = sequences(_table(spark, sf_dir, "conversations"))
    # every conversation begins with up to three turns of the first of its score
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    shared = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("h", h).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    rebuilt = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest)
    return prefix_trie(shared.select("conv_id", rebuilt.alias("turns")))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the faults of the registered query; nulls become one space."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    spoilt = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    made = rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"), spoilt.alias("text"), copies.alias("copies"))
    return made.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("conv_id", "turn", "role", "text")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.repair import repaired, verdicts
    from latticework.llm.scratch import materialize

    given = _table(spark, sf_dir, "conversations")
    rows = damaged(given)
    judged = materialize(verdicts(rows), "repair-verdicts")
    kind = given.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, conv, schema = None, None, pa.schema([("conv_id", given_type), ("repaired_sha256", pa.string())])
        for batch in batches:
            done = []
            for own, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if told is not None and own == conv:
                    told.update(b"\n")
                else:
                    if told is not None:
                        done.append({"conv_id": conv, "repaired_sha256": told.hexdigest()})
                    told, conv = hashlib.sha256(), own
                told.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if told is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": told.hexdigest()}], schema=schema)

    given_type = to_arrow_type(given.schema["conv_id"].dataType)
    digests = repaired(rows, judged).mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = given.select("conv_id").distinct()
    left, right = judged.withColumnRenamed("conv_id", "own"), digests.withColumnRenamed("conv_id", "own_2")
    every = ids.join(left, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(right, F.col("conv_id").eqNullSafe(F.col("own_2")), "left")
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_sha256(""))).alias("repaired_sha256"),
    )


def op13_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.exact_dedup import exact_groups

    found = exact_groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii_pseudonyms": op1_pii_pseudonyms,
        "op2_chat_paths": op2_chat_paths,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_warc_revisits": op4_warc_revisits,
        "op5_line_quality": op5_line_quality,
        "op6_rule_ensemble": op6_rule_ensemble,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_nearest_toxic": op9_nearest_toxic,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_structure_repair": op12_structure_repair,
        "op13_cuckoo_dedup": op13_cuckoo_dedup,
    }


_CHAT_SQL = r"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x,
    '<\\*(/?s>|/?<SYS>>|</SYS>>|\|)|\[\\*/?(INST|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)\]' AS control FROM rows),
c AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS told,
    coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '') AS loss,
    sum(12 + length(r) + 2 * len(regexp_extract_all(r, control)) + length(r) - length(replace(replace(r, chr(92), ''), chr(10), ''))
        + 1 + length(x) + len(regexp_extract_all(x, control)) + 10 + 1)::BIGINT AS inner_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, 7 + inner_chars AS formatted_chars FROM c
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, url, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest FROM h),
j AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM b WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to FROM j
"""

_LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
places AS (SELECT id, unnest(range(1, len(ws) - 6)) AS i, ws FROM s WHERE len(ws) > 7),
windows AS (SELECT id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM places),
again AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
steps AS (SELECT id, least(8, coalesce(i - lag(i) OVER (PARTITION BY id ORDER BY i), 8)) AS new_words FROM again),
repeats AS (SELECT id, sum(new_words)::BIGINT AS n FROM steps GROUP BY id),
parts AS (SELECT id, source, t, list_filter(regexp_split_to_array(lower(unnest(ls)), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS p FROM s),
lines AS (SELECT id, source, t, array_to_string(p, ' ') AS line, len(p) AS n FROM parts),
hosts AS (SELECT source, count(DISTINCT t) AS n_docs FROM s GROUP BY source),
held AS (SELECT source, line, count(DISTINCT t) AS n FROM lines GROUP BY source, line HAVING count(DISTINCT t) > 3),
frequent AS (SELECT held.source, line FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE n > 0.05 * n_docs),
removed AS (SELECT id, sum(lines.n)::BIGINT AS n FROM lines JOIN frequent ON lines.source IS NOT DISTINCT FROM frequent.source AND lines.line = frequent.line GROUP BY id),
base AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS gone
    FROM s LEFT JOIN repeats USING (id) LEFT JOIN removed USING (id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone <= 0.8 * n_words AND n_words - gone >= 20 AS kept FROM judged
"""

_TOP_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_EXACT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
r AS (SELECT doc_id, sha256(n) AS text_sha256, count(*) OVER (PARTITION BY n) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of ASCII ``text``, a byte and a bit at a time."""
    bits = "list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


_TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, turn, r, substr(sha256(length(r) || ':' || r || x), 1, 32) AS l, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
own AS (SELECT conv_id, list({{'l': l, 'w': w}} ORDER BY turn NULLS FIRST, r, l) AS turns FROM l GROUP BY conv_id),
h AS (SELECT *, {_crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM own),
s AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS s FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
d AS (SELECT conv_id, len(s) AS n, s, unnest(range(len(s) + 1)) AS depth FROM s),
k AS (SELECT conv_id, n, depth, array_to_string(list_transform(s[1:depth], lambda x: x.l), '/') AS key, coalesce(s[depth].w, 0) AS w,
    CASE WHEN depth > 0 THEN array_to_string(list_transform(s[1:depth - 1], lambda x: x.l), '/') END AS above FROM d),
nodes AS (SELECT key, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM k GROUP BY key, depth),
children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
under AS (SELECT DISTINCT a.key AS top, b.key FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
rolled AS (SELECT top AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM under JOIN full_nodes USING (key) GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN rolled USING (key) LEFT JOIN nodes p ON p.key = f.above
"""


def _more(value: str, cost: str, letter: str) -> str:
    """A cost in six digits and the edits so far, with one more edit; the least string is the cheapest, then the ASCII-least."""
    return f"(lpad((substr({value}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({value}, 7) || '{letter}')"


def _any_more(values: str, cost: str, letter: str) -> str:
    return "least(" + ", ".join(_more(v, cost, letter) for v in values.split()) + ")"


_REPAIR_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
m AS (SELECT *, {_crc32_sql('place')} % 20 AS fault FROM c),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m),
l AS (SELECT *, substr(role, 1, 1) AS a, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, substr(sha256(length(role) || ':' || role || text), 1, 32) AS label FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, label, copy) AS i FROM l),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(a) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS may, (coalesce(fault, '') = 'truncated')::INT AS t FROM f),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || a NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
v AS (SELECT conv_id, 0::BIGINT AS i, '000000' AS v0, NULL::VARCHAR AS v1, '000002I' AS v2, '000004II' AS v3 FROM counts
    UNION ALL SELECT conv_id, i, w0, w1, least(w2, {_any_more('w0 w1 w3', '2', 'I')}),
        least(w3, {_more(f"least(w2, {_any_more('w0 w1 w3', '2', 'I')})", '2', 'I')}) FROM (
      SELECT g.conv_id, g.i, {_more('v0', '3', 'D')} AS w0, least({_more('v1', '3', 'D')}, CASE WHEN may AND a = 's' THEN {_more('v0', 't', 'K')} END) AS w1,
        least({_more('v2', '3', 'D')}, CASE WHEN may THEN {_any_more('v0 v1 v3', '2 + t', 'R')} END, CASE WHEN may AND a = 'u' THEN {_any_more('v0 v1 v3', 't', 'K')} END) AS w2,
        least({_more('v3', '3', 'D')}, CASE WHEN may THEN {_more('v2', '2 + t', 'R')} END, CASE WHEN may AND a = 'a' THEN {_more('v2', 't', 'K')} END) AS w3
      FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1)),
best AS (SELECT counts.*, substr(least(v0, v3), 1, 6)::BIGINT AS cost, substr(least(v0, v3), 7) AS audit FROM counts JOIN v ON counts.conv_id IS NOT DISTINCT FROM v.conv_id AND n = v.i),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
read AS (SELECT conv_id, p, audit[p] AS letter, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS e FROM letters),
shown AS (SELECT r.conv_id, p, letter, e, CASE WHEN letter <> 'I' THEN role END AS role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text,
    max((e = 1 AND letter = 'K' AND a = 's')::INT) OVER (PARTITION BY r.conv_id) AS s FROM read r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS told
    FROM shown WHERE letter <> 'D' GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM ids LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force."""
    return {
        "op2_chat_paths": _CHAT_SQL.strip(),
        "op4_warc_revisits": _WARC_SQL.strip(),
        "op5_line_quality": _LINES_SQL.strip(),
        "op8_exact_top_k": _TOP_SQL.strip(),
        "op11_prefix_trie": _TRIE_SQL.strip(),
        "op12_structure_repair": _REPAIR_SQL.strip(),
        "op13_cuckoo_dedup": _EXACT_SQL.strip(),
    }
