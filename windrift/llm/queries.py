"""The registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.llm.common import Scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.sharding import shard_documents

    out = shard_documents(Scratch(spark), table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.suffixes import repeated_passages

    return repeated_passages(Scratch(spark), table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.mixing import mix_documents

    out = mix_documents(Scratch(spark), table(spark, sf_dir, "documents"))
    shards = F.concat_ws(",", F.transform("shards", lambda s: F.concat(s["out_shard"].cast("string"), F.lit(":"), s["words"].cast("string"))))
    return out.select("doc_id", "size", "source_size", "target", "taken", shards.alias("taken_by_shard"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.embeddings import near_duplicates

    return near_duplicates(Scratch(spark), table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.packing import pack_documents

    return pack_documents(Scratch(spark), table(spark, sf_dir, "documents"), tokenizer_path())


def op7_weighted_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.weighted_minhash import near_duplicate_classes

    return near_duplicate_classes(Scratch(spark), table(spark, sf_dir, "documents")).drop("uid")


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.recompression import remove_repeats

    return remove_repeats(Scratch(spark), table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), keep_columns=["doc_id"]).drop("longest_repeat")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.whitening import whitened

    return whitened(Scratch(spark), table(spark, sf_dir, "embeddings"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.neighbours import search

    return search(Scratch(spark), table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrift.llm.interaction import filter_interactions

    return filter_interactions(Scratch(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_mixing": op4_mixing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_weighted_minhash_dedup": op7_weighted_minhash_dedup,
    "op8_recompression_dedup": op8_recompression_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_neighbours": op12_neighbours,
    "op13_filter_interaction": op13_filter_interaction,
    "pipeline": pipeline,
}

# The same results in DuckDB's SQL, where SQL can say them: words, windows and pairs in full, without any of the operators' ways.
WORDS = r"d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"


def windows(name: str, size: int, alone: bool) -> str:
    """(r, i): where windows of so many words start that occur twice or more, in their text or in all texts."""
    every = f"SELECT r, i, array_to_string(w[i : i + {size - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM d WHERE len(w) >= {size})"
    return f"{name} AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY {'r, ' if alone else ''}s) AS n FROM ({every})) WHERE n > 1)"


def covered(name: str, source: str, size: int) -> str:
    return f"{name} AS (SELECT DISTINCT r, unnest(range(i, i + {size})) AS j FROM {source})"


REACH = "reach(node, seen) AS (SELECT node, node FROM nodes UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.seen = l.a)"

ORACLES: dict[str, str] = {
    "op5_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.93),
nodes AS (SELECT vec_id AS node FROM v), {REACH}, c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component AS component_id, vec_id = component AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id""",
    "op7_weighted_minhash_dedup": f"""WITH RECURSIVE {WORDS}, g AS (SELECT r, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
b AS (SELECT r, s, count(*) AS c FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM d), f AS (SELECT s, ln(1 + max(n) / greatest(count(*), 1, 0.001 * max(n))) AS f FROM b, n GROUP BY 1), x AS (SELECT r, s, c * f AS w FROM b JOIN f USING (s)),
t AS (SELECT r, sum(w) AS w FROM x GROUP BY 1), p AS (SELECT a.r AS a, b.r AS b, sum(least(a.w, b.w)) AS m FROM x a JOIN x b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN t ta ON ta.r = a JOIN t tb ON tb.r = b WHERE m >= 0.8 * (ta.w + tb.w - m) * (1 - 1e-9) UNION SELECT a.r, b.r FROM d a JOIN d b ON a.text = b.text AND a.r <> b.r),
nodes AS (SELECT r AS node FROM d), {REACH}, c AS (SELECT node, min(doc_id) AS class_id, count(*) AS class_size FROM reach JOIN d ON seen = r GROUP BY 1)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM d JOIN c ON node = r""",
    "op8_recompression_dedup": f"""WITH {WORDS}, {windows('a', 35, False)}, {covered('g', 'a', 35)}, x AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept FROM x ANTI JOIN g USING (r, j) GROUP BY 1), n AS (SELECT r, count(*) AS n FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)""",
    "op10_quality_rules": rf"""WITH {WORDS}, {windows('a5', 5, True)}, {covered('g5', 'a5', 5)}, {windows('a8', 8, True)}, {covered('g8', 'a8', 8)}, {windows('a51', 51, True)},
n5 AS (SELECT r, count(*) AS n5 FROM g5 GROUP BY 1), n8 AS (SELECT r, count(*) AS n8 FROM g8 GROUP BY 1), n51 AS (SELECT DISTINCT r, true AS long FROM a51),
m AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n, CAST(coalesce(n5, 0) AS BIGINT) AS n5, CAST(coalesce(n8, 0) AS BIGINT) AS n8, coalesce(long, false) AS long, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d LEFT JOIN n5 USING (r) LEFT JOIN n8 USING (r) LEFT JOIN n51 USING (r))
SELECT doc_id, n AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
n5 AS n_repeat_words, n < 10 OR 100 * n5 > 20 * n AS base_failed, NOT (n < 10 OR 100 * n5 > 20 * n) AND n8 <= 0.15 * n AND NOT long AS kept, n8 AS covered_words FROM m""",
    "op13_filter_interaction": rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), x AS (SELECT doc_id, part, t, len(w) AS n, len(list_distinct(w)) AS u FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, n < 200 AS a, 100 * u < 50 * n AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM x LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM f),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
o(o) AS (SELECT '' UNION ALL SELECT o || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE length(o) < 5 AND NOT contains(o, c)),
s AS (SELECT o AS filter_order, k AS step, o[k] AS c, o[1 : k - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5),
r AS (SELECT part, filter_order, step, c, contains(fails, c) AS here, before <> '' AND regexp_matches(fails, '[' || before || '-]') AS gone, fails = c AS alone, n, good, toxic FROM g, s),
z AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, c, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM z""",
}
