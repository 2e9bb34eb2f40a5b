"""Registered queries of the operators, with plain SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import public_tokenizers

from pulseframe.llm import bpe, decontaminate, divergence, exact_dedup, importance, katz, language_id, near_dedup, quality_rules, secrets, substrings, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A-Z in lower case, in DuckDB
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_exact_dedup", f"""
    WITH t AS (SELECT doc_id, sha256({SQL_LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
    FROM t
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read(spark, sf_dir))


def held_out(parts: int) -> Column:
    """Rows that a model is judged on: a fixed fold by the checksum of the doc_id's text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    model = language_id.train(language_id.sample(docs.filter(~held_out(4))))
    return language_id.predict(docs, model).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    labels = read(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    scored = toxicity.score(docs, toxicity.train(docs, labels, ("low_quality", "toxic")))
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


@query("op4_katz")
def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    model = katz.train(docs.filter(~held_out(7)))
    return katz.score(docs, model).select(
        "doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(read(spark, sf_dir), path, public_tokenizers.PATTERN)


@query("op6_substrings", r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t)
    ),
    sources AS (SELECT k, min(doc_id) AS source FROM windows GROUP BY k),
    gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
        FROM windows JOIN sources USING (k) WHERE source < doc_id
    ),
    words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t),
    marked AS (SELECT words.*, gone.p IS NOT NULL AS removed FROM words LEFT JOIN gone USING (doc_id, p)),
    kept AS (
        SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT removed) AS kept
        FROM marked GROUP BY doc_id
    )
    SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM t LEFT JOIN kept USING (doc_id)
""")
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(read(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir), width=2)


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_leaks(read(spark, sf_dir), read(spark, sf_dir, "benchmark"), least_words=1)
    return hits.withColumn("contaminated", F.lit(True))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(read(spark, sf_dir), path, public_tokenizers.PATTERN)


@query("op13_quality_rules", r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
    twice AS (SELECT doc_id, k FROM windows GROUP BY ALL HAVING count(*) > 1),
    repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
                FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM windows JOIN twice USING (doc_id, k)) GROUP BY 1),
    lines AS (SELECT doc_id, host, l, lower(trim(l, chr(9) || chr(11) || chr(12) || chr(13) || ' ')) AS k
              FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
    dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, sum(length(k)) AS chars FROM lines GROUP BY 1),
    common AS (SELECT host, k FROM lines GROUP BY ALL HAVING count(DISTINCT doc_id) > 10),
    gone AS (SELECT doc_id, sum(length(k)) AS gone, count(*) AS n_common_lines FROM lines JOIN common USING (host, k) GROUP BY 1),
    base AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(gone, 0) AS gone,
                    coalesce(n_common_lines, 0) AS n_common_lines
             FROM t LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN gone USING (doc_id)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND 2 * (chars - gone) >= chars AS kept, n_common_lines FROM judged
""")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir))


@query("op12_importance", f"""
    WITH crc_table AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
            FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
    ),
    t AS (SELECT 'd' AS side, doc_id, regexp_extract_all({SQL_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
          UNION ALL SELECT 'b', NULL, regexp_extract_all({SQL_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
    feats AS (SELECT side, doc_id, unnest(ws) AS w FROM t),
    hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM feats)),
    bucketed AS (
        SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
                   lambda c, b: xor(c // 256, crc_table.t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
        FROM hexed, crc_table
    ),
    hits AS (SELECT side, doc_id, bucket FROM feats JOIN bucketed USING (w)),
    per AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM hits GROUP BY 1),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (S_ + 10000) AS DOUBLE) / CAST((s + 1) * (T_ + 10000) AS DOUBLE))) AS BIGINT) AS g
             FROM per, (SELECT CAST(sum(s) AS BIGINT) AS S_, CAST(sum(t) AS BIGINT) AS T_ FROM per)),
    sums AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS g, count(*) AS n FROM hits JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
    weighed AS (SELECT doc_id, len(ws) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
                       CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
                FROM t LEFT JOIN sums USING (doc_id) WHERE side = 'd'),
    scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
    ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN r END AS rank
    FROM ranked
""")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_divergence", f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({SQL_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    uses AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM t),
    kept AS (SELECT lang, term FROM uses GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
    vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
    groups AS (SELECT DISTINCT lang, source FROM t),
    hits AS (SELECT lang, source, term, count(*) AS c FROM uses JOIN kept USING (lang, term) GROUP BY ALL),
    ns AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM groups LEFT JOIN hits USING (lang, source) GROUP BY ALL),
    p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p
          FROM ns JOIN vs USING (lang) JOIN kept USING (lang) LEFT JOIN hits USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000 * (sum(c)::BIGINT + 5)) // (any_value(big_n) + 5 * any_value(v)) AS q
          FROM hits JOIN vs USING (lang) JOIN (SELECT lang, sum(n)::BIGINT AS big_n FROM ns GROUP BY 1) USING (lang) GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d, 0) AS value
             FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p))::BIGINT AS d
                        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS z
             ON z.lang = a.lang AND s1 = a.source AND s2 = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
          FROM (FROM pair UNION ALL FROM terms))
    WHERE part = 'pair' OR rank <= 50
""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir))
