"""One query an operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.dedup_stream import exact_groups
from tidemark.llm.language import identify
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.phrases import collocations
from tidemark.llm.pii import personal_data
from tidemark.llm.ppm import scores
from tidemark.llm.repeats import without_repeats
from tidemark.llm.resampling import resampled
from tidemark.llm.rules import quality
from tidemark.llm.separators import token_counts
from tidemark.llm.simhash import near_groups
from tidemark.llm.topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids; null texts, empty tables and ties as in pack()."""
    return pack(_table(spark, sf_dir, "documents"))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null sources and texts, empty tables and ties as in mix()."""
    return mix(_table(spark, sf_dir, "documents"))


def op3_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text; null and very long texts as in personal_data()."""
    return personal_data(_table(spark, sf_dir, "documents"))


def op4_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of its equal texts that stays; nulls, ties and repeated rows as in exact_groups()."""
    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by what the others' labels teach; nulls and texts without a letter as in identify()."""
    return identify(_table(spark, sf_dir, "documents"))


def op6_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without the 50-byte strings of earlier documents; nulls and repeated rows as in without_repeats()."""
    return without_repeats(_table(spark, sf_dir, "documents"))


def op7_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the least id that near fingerprints reach; texts without a word and null ids as in near_groups()."""
    return near_groups(_table(spark, sf_dir, "documents"))


def op8_tokeniser_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each text, and whether its rules and fertility keep it; nulls, repeated rows and texts without a letter as in quality(), an empty table gives no row."""
    return quality(_table(spark, sf_dir, "documents"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document by the separators in flat token files; nulls and special tokens as in token_counts()."""
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of each whole text under PPM and a unigram; nulls, repeated rows and an empty training set as in scores()."""
    return scores(_table(spark, sf_dir, "documents"))


def op11_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of each vector whose id is divisible by 100 with all others."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_crc_ring_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' weights towards the benchmark's texts, and the ranks of the 5 % that are drawn."""
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_bitmap_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of two and three words in all documents."""
    return collocations(_table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mix has no chance in it."""
    return op2_pivotal_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' counts without the tokeniser's."""
    return op8_tokeniser_fertility_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each base kind a text has."""
    return op3_pii_anchor_expansion(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every packing, by document: its pieces follow one another without a gap or an overlap and have all its
    ids, and each of the sequences that they are in is filled from 0 on without a gap or an overlap, up to 4096 ids."""
    p = op1_harmonic_packing(spark, sf_dir)
    of_doc, of_sequence = Window.partitionBy("doc_id").orderBy("start"), Window.partitionBy("sequence_id").orderBy("offset")
    follows = lambda at, w: F.col(at) == F.coalesce(F.lag(F.col(at) + F.col("length")).over(w), F.lit(0))
    each = p.withColumns({"_in_doc": follows("start", of_doc), "_in_sequence": follows("offset", of_sequence), "_end": F.col("start") + F.col("length")})
    fits = F.col("_in_sequence") & (F.col("length") > 0) & (F.col("offset") + F.col("length") <= 4096)
    return each.groupBy("doc_id").agg(F.max("_end").alias("n"), F.max("doc_tokens").alias("of"), F.bool_and("_in_doc").alias("gapless"), F.bool_and(fits).alias("bounded")).select("doc_id", (F.col("n") == F.col("of")).alias("whole"), "gapless", "bounded")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_pii_anchor_expansion": op3_pii_anchor_expansion,
    "op4_streaming_exact_dedup": op4_streaming_exact_dedup,
    "op5_ftrl_language_id": op5_ftrl_language_id,
    "op6_bwt_repeats": op6_bwt_repeats,
    "op7_simhash_multi_index": op7_simhash_multi_index,
    "op8_tokeniser_fertility_rules": op8_tokeniser_fertility_rules,
    "op9_separator_scan": op9_separator_scan,
    "op10_ppm_scoring": op10_ppm_scoring,
    "op11_block_max_top_k": op11_block_max_top_k,
    "op12_crc_ring_resampling": op12_crc_ring_resampling,
    "op13_bitmap_collocations": op13_bitmap_collocations,
    "mix_targets": mix_targets,
    "rules_base": rules_base,
    "pii_base": pii_base,
    "packed_tokens": packed_tokens,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) + 1 - i] AS INTEGER) ELSE CAST(d[length(d) + 1 - i] AS INTEGER) * 2 - CASE WHEN d[length(d) + 1 - i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"

ORACLES: dict[str, str] = {
    "op11_block_max_top_k": """
        WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.k, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v AS q JOIN v ON q.k <> v.k WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # caps are three times a source's size; a source at its cap leaves its share to the others, by weight, until none is above: as many rounds as sources at most
    "mix_targets": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, length({_WORDS}) AS size FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY 1),
             o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source IS NULL, source) AS r, sum(source_size) OVER () AS total FROM s),
             l AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY r DESC)) AS level FROM o),
             f AS (SELECT min(r) AS r FROM l WHERE level * weight <= 3 * source_size),
             t AS (SELECT source, source_size, least(3.0 * source_size, weight * coalesce((SELECT level FROM l JOIN f USING (r)), 1e300)) AS target FROM l)
        SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "rules_base": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
             g AS (SELECT k, i, list_aggregate(w[i:i + 4], 'string_agg', chr(10)) AS g FROM (SELECT k, w, unnest(range(1, greatest(length(w) - 3, 1))) AS i FROM d)),
             c AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g),
             r AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY 1),
             b AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
        SELECT doc_id, length(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * length(w) AS base_failed
        FROM d LEFT JOIN b USING (k) LEFT JOIN r USING (k)""",
    "pii_base": rf"""
        WITH f AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip,
                          regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+') AS card, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') AS phone FROM f),
             e AS (SELECT doc_id, email, list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) < 4 AND CAST('0' || right(p, 3) AS INTEGER) <= 255))) AS ip,
                          list_filter(list_transform(card, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 14 AND 19 AND {_LUHN}) AS card,
                          list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15) AS phone FROM m)
        SELECT doc_id, length(email) AS n_email, length(ip) AS n_ip, length(card) AS n_card, length(phone) AS n_phone FROM e""",
    "packed_tokens": "SELECT doc_id, true AS whole, true AS gapless, true AS bounded FROM documents",
    "op4_streaming_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    # phrases and their parts have one space between words, so a phrase is found by its string
    "op13_bitmap_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
             t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
             g AS (SELECT lang, unnest([w[i:i + j] FOR i IN range(1, len(w) - j + 1)]) AS g FROM (SELECT lang, w, unnest(range(3)) AS j FROM w) WHERE len(w) > j),
             f AS (SELECT lang, g, list_aggregate(g, 'string_agg', ' ') AS s, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY 1, 2),
             k AS (SELECT lang, g, s AS phrase, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND a >= 10),
             c AS (SELECT k.lang, g, phrase, k.a, k, l.a AS l, r.a AS r, 1000000 * k.a * k.a // (l.a * r.a) AS score FROM k
                   JOIN (SELECT lang, s, a FROM f) AS l ON l.lang = k.lang AND l.s = list_aggregate(g[:k], 'string_agg', ' ') JOIN (SELECT lang, s, a FROM f) AS r ON r.lang = k.lang AND r.s = list_aggregate(g[k + 1:], 'string_agg', ' ')),
             b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             x AS (SELECT lang, list_aggregate(g[i:i + 1], 'string_agg', ' ') AS phrase, max(a) AS most FROM (SELECT lang, g, a, unnest([1, 2]) AS i FROM b WHERE len(g) = 3) GROUP BY 1, 2),
             q AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) AS rank FROM b LEFT JOIN x USING (lang, phrase) WHERE len(g) = 3 OR most IS NULL OR 100 * most < 50 * b.a)
        SELECT lang, rank, phrase, CAST(q.a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM q JOIN t USING (lang) WHERE rank <= 2000""",
    # bytes as two hex digits each: all 50-byte strings, those that start in a smaller doc_id too, their runs, and what is between these
    "op6_bwt_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
             f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING count(*) > 1),
             r AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE m < doc_id),
             e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
             b AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
             s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM b GROUP BY doc_id, k),
             q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
             k AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(z) AS last FROM q JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
