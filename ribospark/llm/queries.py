"""The thin queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.llm import decontamination, html_extraction, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, suffix_dedup, token_output, url_filters, vector_codes, whitening
from ribospark.llm.common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge_quality(docs, quality_rules.fit_quality(docs, _table(spark, sf_dir, "labels")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``documents`` mixed with each row's source as its only source."""
    return mixing.mix_sources(docs, F.array(F.col("source").cast("string")), mixing.word_count(F.col("text")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The id that ends a document.
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("_h")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = remainder(F.col("doc_id"), 7) != 2
    scored = lm_scoring.score_texts(_table(spark, sf_dir, "documents"), learn)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_units(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_units", "n_removed", "removed_words", "longest_run", "starts", "ends", "kept_docs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), url_filters.default_rules())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(_table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extraction.extract_text(pages, html_extraction.learn_layout(pages))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))


def _op5_sql() -> str:
    rules = sorted(url_filters.HOST_RULES, key=lambda r: (len(r[0]), r[0]), reverse=True)

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    action = " ".join(f"WHEN rule = '{r}' THEN '{a}'" for r, a in rules)
    allowed = [p for p in url_filters.PATTERN_RULES if p[1] == "allow"]
    blocked = [p for p in url_filters.PATTERN_RULES if p[1] == "block"]
    pattern = " ".join(f"WHEN rule IS NULL AND regexp_matches(host || path, '{p[2]}') THEN '{p[0]}'" for group in (allowed, blocked) for p in sorted(group, reverse=True))
    names = ", ".join(f"'{p[0]}'" for p in blocked)
    return f"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
        parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
        ruled AS (SELECT *, CASE {rule} END AS rule FROM parts),
        matched AS (SELECT *, CASE {pattern} END AS pattern FROM ruled)
        SELECT page_id, host, path, rule,
               CASE {action} WHEN pattern IN ({names}) THEN 'block' ELSE 'allow' END AS verdict, pattern
        FROM matched"""


# Columns of the operators' results that SQL can express, as queries of their own.


def base_lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 counts: everything but the model's score."""
    return op2_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 counts: everything but the trees' verdict."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 aims at, and whether a source's taken words come within its largest document of it."""
    mixed = mix_documents(_table(spark, sf_dir, "documents")).withColumn("source", F.col("members")[0])
    near = mixed.groupBy("source").agg((F.abs(F.sum("taken") - F.first("target")) <= F.max("size")).alias("near"))
    joined = mixed.alias("m").join(near.alias("n"), F.col("m.source").eqNullSafe(F.col("n.source")))
    return joined.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "near", (F.col("taken") <= 3 * F.col("size")).alias("within"))


def base_language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10 the fold, and which documents get no language."""
    return op10_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("unknown"), F.col("score").between(0, 1).alias("in_range"))


_CRC = """
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
_WORDS = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def _base_lm_sql() -> str:
    words = _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_CRC.format(text="CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out, list_append({words}, '') AS w FROM documents),
        tokens AS (SELECT r, held_out, unnest(w) AS t FROM docs),
        counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
        sums AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM counts),
        scored AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
                   FROM tokens LEFT JOIN counts USING (t), sums GROUP BY r)
        SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 4) AS base_score FROM scored JOIN docs USING (r), sums"""


def _base_quality_sql() -> str:
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w,
                             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
        places AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs),
        windows AS (SELECT r, i, list_slice(w, i, i + 2) AS x FROM places),
        often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
        covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY r),
        counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
                    FROM docs LEFT JOIN covered USING (r))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted"""


def _base_mixing_sql() -> str:
    return f"""
        WITH docs AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="text")}) AS BIGINT) AS size FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM docs GROUP BY source),
        ranked AS (SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3 * source_size / weight, weight, source) AS k FROM sources),
        before AS (SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
                          sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM ranked),
        free AS (SELECT min(k) AS k FROM before WHERE 3 * source_size >= weight * spare / weights),
        unit AS (SELECT spare / weights AS u FROM before JOIN free USING (k)),
        targets AS (SELECT source, source_size, CASE WHEN k < (SELECT k FROM free) THEN 3.0 * source_size ELSE weight * (SELECT u FROM unit) END AS target FROM before)
        SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 3) AS target, true AS near, true AS within
        FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source"""


def _base_language_sql() -> str:
    return f"""
        SELECT doc_id, {_CRC.format(text="CAST(doc_id AS VARCHAR)")} % 3 = 1 AS held_out,
               NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS unknown, true AS in_range FROM documents"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_lm_scoring": op2_lm_scoring, "op3_token_output": op3_token_output, "op4_quality_rules": op4_quality_rules, "op5_url_filters": op5_url_filters, "op6_line_dedup": op6_line_dedup, "op7_mixing": op7_mixing, "op8_near_dedup": op8_near_dedup, "op9_suffix_dedup": op9_suffix_dedup, "op10_language_id": op10_language_id, "op11_whitening": op11_whitening, "op12_html_extraction": op12_html_extraction, "op13_vector_codes": op13_vector_codes, "base_lm_counts": base_lm_counts, "base_quality_counts": base_quality_counts, "base_mixing_targets": base_mixing_targets, "base_language_folds": base_language_folds}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": _op5_sql(), "base_lm_counts": _base_lm_sql(), "base_quality_counts": _base_quality_sql(), "base_mixing_targets": _base_mixing_sql(), "base_language_folds": _base_language_sql()}
