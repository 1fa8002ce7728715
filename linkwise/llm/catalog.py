"""Registered queries of the training-data operators, with production parameters.

Each query runs its operator over the whole intended table. SQL is given where
DuckDB can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwise.llm import (
    chat_format,
    collocations,
    decontaminate,
    mih_search,
    packing,
    pii,
    recompression,
    simhash,
    suffix_dedup,
    token_alignment,
    token_counts,
    tournament_packing,
    toxicity,
)
from linkwise.llm.common import crc_fold, out_id, table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; it is read where it is, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return found.select(out_id(), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_mih_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih_search.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_by_row(table(spark, sf_dir, "documents"))
    return found.select(out_id(), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_context")


def packed(docs: DataFrame) -> DataFrame:
    found = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, closing_id=0)
    return found.select(out_id(), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                        F.col("sequence").alias("sequence_id"), "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(out_id(), "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT doc_id, unnest(range(1, greatest(1, len(w) - 18))) AS i, w FROM d
), h AS (
    SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM s
), r AS (
    SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM h) WHERE n > 1
), g AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r
), p AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, FROM d
), k AS (
    SELECT p.doc_id, count(*) AS n_words, count(g.p) AS n_removed,
        string_agg(p.word, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS kept
    FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(out_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP6_SQL = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
    SELECT doc_id, x, unnest(range(1, greatest(1, length(x) // 2 - 48))) AS i FROM d
), h AS (
    SELECT doc_id, i, md5(substr(x, 2 * i - 1, 100)) AS h FROM w
), m AS (
    SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)
), r AS (
    SELECT h.doc_id, h.i FROM h JOIN m ON h.h = m.h WHERE h.doc_id > m.first
), o AS (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM r
), g AS (
    SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o
), s AS (
    SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run
), t AS (
    SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM s
), k AS (
    SELECT t.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
        string_agg(substr(d.x, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(d.x), 2 * max(b) - 1) AS kept
    FROM t JOIN d ON t.doc_id = d.doc_id GROUP BY t.doc_id
)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, d.x))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        out_id(), (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
        F.array_join(F.array_sort(F.transform("matches", lambda m: m["item"])).cast("array<string>"), ",").alias("items"),
        F.coalesce(F.array_min(F.transform("matches", lambda m: m["edits"])), F.lit(-1)).alias("least_edits"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.passages(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select(out_id(), (crc_fold(out_id()) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


#: A conversation whose texts hold every control string of the template.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_format.records_of(table(spark, sf_dir, "conversations"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(
        F.lit(CONTROL_TEXT).alias("instruction"), F.lit(CONTROL_TEXT).alias("output"))).alias("record"))
    out = chat_format.formatted(chat_format.canonical_turns(records.unionByName(extra)))
    turns, loss = chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss"))
    read = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS body,
        length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS head FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + head + 2 + body + 9) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(out_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op11_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tournament_packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048, closing_id=1)
    return found.select(out_id(), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
                        F.col("sequence").alias("sequence_id"), "offset")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
                                  tokenizer_file("piece_bpe_32k.model"))
    return found.select(out_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), t AS (
    SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), s AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
    WHERE i + k - 1 <= len(w)
), f AS (
    SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), x AS (
    SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), y AS (
    SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, t.n,
        (1000::HUGEINT * x.a * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest
    JOIN t ON t.lang = x.lang
), z AS (
    SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), u AS (
    SELECT s.lang, s.phrase FROM c s JOIN (
        SELECT lang, a, unnest([array_to_string(w[2:], ' '), array_to_string(w[1:k - 1], ' ')]) AS phrase FROM c WHERE k >= 3
    ) b ON b.lang = s.lang AND b.phrase = s.phrase AND 100 * b.a >= 100 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z ANTI JOIN u USING (lang, phrase) QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_mih_search": op2_mih_search,
        "op3_pii": op3_pii,
        "op4_packing": op4_packing,
        "op5_recompression": op5_recompression,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_chat_format": op9_chat_format,
        "op10_simhash": op10_simhash,
        "op11_tournament_packing": op11_tournament_packing,
        "op12_token_alignment": op12_token_alignment,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_recompression": OP5_SQL,
        "op6_suffix_dedup": OP6_SQL,
        "op9_chat_format": OP9_SQL,
        "op13_collocations": OP13_SQL,
    }
