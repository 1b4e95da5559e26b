"""The dealt operators as queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm import (exact_dedup, fingerprints, lexical_search, lines, minhash, mixing, packing, periodic_runs,
                            pii, quality_rules, sharding, token_files, toxicity)
from corpusfold.session import spread, write_shared

SHARDS = 16
# The key of the pseudonyms of the synthetic tables; real texts need a secret one, from the session's settings.
PII_KEY_CONF, PII_TEST_KEY = "spark.corpusfold.pii.key", "synthetic tables"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_packing(spark, sf):
    pieces = packing.document_pieces(_table(spark, sf, "documents"), TOKENIZER)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack_pieces(digests)


def op2_pseudonyms(spark, sf):
    return pii.pseudonymise(_table(spark, sf, "documents"), spark.conf.get(PII_KEY_CONF, PII_TEST_KEY))


def op3_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(_table(spark, sf, "documents"))


def op4_near_dedup(spark, sf):
    return minhash.near_duplicates(_table(spark, sf, "documents"))


def op5_mixing(spark, sf):
    return mixing.mix(_table(spark, sf, "documents"))


def op6_shards(spark, sf):
    return sharding.shard_by_size(_table(spark, sf, "documents"), SHARDS)


def op7_fingerprints(spark, sf):
    return fingerprints.fingerprint_edits(_table(spark, sf, "documents"))


def op8_toxicity(spark, sf):
    docs = _table(spark, sf, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, _table(spark, sf, "labels")))


def op9_line_dedup(spark, sf):
    # The lines are read twice, the pages once.
    pages = write_shared(_table(spark, sf, "pages").select(
        "page_id", lines.page_host(F.col("url")).alias("host"), lines.page_lines(F.col("html")).alias("text")), "page-lines")
    return lines.drop_boilerplate(pages, F.col("host")).select(
        "page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_token_files(spark, sf):
    docs = _table(spark, sf, "documents")
    manifest = token_files.write_token_files(docs, TOKENIZER)
    return token_files.read_token_files(manifest, docs).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_quality_rules(spark, sf):
    return quality_rules.quality(spread(_table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_lexical_search(spark, sf):
    docs = spread(_table(spark, sf, "documents").select("doc_id", "text"))
    return lexical_search.rank(docs, _table(spark, sf, "benchmark"))


def _with_rounds(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth text, by its id, goes round from a word on, as the contract of the query has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    parts = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("bigint"))
    parts = parts.withColumn("a", F.col("g") % F.when(F.col("n") > 0, F.col("n")))
    parts = parts.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    rest, period = (F.col("n") - F.col("a")).cast("int"), F.col("p").cast("int")
    rounds = F.flatten(F.array_repeat(F.slice("words", F.col("a").cast("int") + 1, period), F.ceil(rest / period).cast("int")))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(rounds, F.lit(1), rest)), " ")
    return parts.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf):
    docs = _with_rounds(spread(_table(spark, sf, "documents").select("doc_id", "text")))
    best = periodic_runs.strongest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs.periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.expr("(1000L * best.length) DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (
    op1_packing, op2_pseudonyms, op3_exact_dedup, op4_near_dedup, op5_mixing, op6_shards, op7_fingerprints, op8_toxicity,
    op9_line_dedup, op10_token_files, op11_quality_rules, op12_lexical_search, op13_periodic_runs)}


def _quality_sql() -> str:
    names = [name for name, *_ in quality_rules.RULES]
    values = ", ".join(f"({part} * {quality_rules.UNIT}) // greatest({whole}, 1) AS {name}"
                       for name, part, whole, _, _ in quality_rules.RULES)
    least = " ".join(f"WHEN '{name}' THEN {step}" for name, *_, step in quality_rules.RULES)
    sides = ", ".join(f"'{name}'" for name, _, _, two_sided, _ in quality_rules.RULES if two_sided)
    levels = {"g": "lang, source", "l": "lang, NULL AS source", "a": "NULL AS lang, NULL AS source"}
    coarser = " UNION ALL ".join(f"SELECT '{level}' AS level, {keys}, rule, cell FROM cells" for level, keys in levels.items())
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
        w AS MATERIALIZED (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word
            FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
        g AS MATERIALIZED (SELECT r, i, word || ' ' || lead(word) OVER t || ' ' || lead(word, 2) OVER t AS gram
            FROM w WINDOW t AS (PARTITION BY r ORDER BY i)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
        repeats_ AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY r),
        words_ AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY r),
        lines_ AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        m AS MATERIALIZED (SELECT r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN words_ USING (r) LEFT JOIN lines_ USING (r) LEFT JOIN repeats_ USING (r)),
        v AS MATERIALIZED (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words
            AS base_failed, {values} FROM m),
        tall AS MATERIALIZED (UNPIVOT v ON {', '.join(names)} INTO NAME rule VALUE value),
        cells AS (SELECT lang, source, rule, (((value >> s) + 1) << s) - 1 AS cell FROM
            (SELECT *, greatest(length(bin(value)) - 8, 0) AS s FROM tall WHERE NOT base_failed)),
        counted AS (SELECT level, lang, source, rule, cell, count(*) AS n FROM ({coarser}) GROUP BY ALL),
        run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY cell) AS below,
            sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM counted),
        q AS (SELECT level, lang, source, rule, max(total) AS docs, min(cell) FILTER (WHERE 4 * below >= total) AS q1,
            min(cell) FILTER (WHERE 4 * below >= 3 * total) AS q3 FROM run GROUP BY level, lang, source, rule),
        f AS MATERIALIZED (SELECT level, lang, source, rule, docs, CASE WHEN rule IN ({sides}) THEN q1 - reach ELSE 0 END AS low,
            q3 + reach AS high FROM (SELECT *, {quality_rules.FENCE} * greatest(q3 - q1, CASE rule {least} END) AS reach FROM q)),
        j AS (SELECT t.r, bool_and(value BETWEEN
                CASE WHEN o.docs >= {quality_rules.LEAST_DOCS} THEN o.low WHEN l.docs >= {quality_rules.LEAST_DOCS} THEN l.low ELSE a.low END AND
                CASE WHEN o.docs >= {quality_rules.LEAST_DOCS} THEN o.high WHEN l.docs >= {quality_rules.LEAST_DOCS} THEN l.high ELSE a.high END) AS fits
            FROM tall t JOIN f o ON o.level = 'g' AND o.rule = t.rule AND o.lang IS NOT DISTINCT FROM t.lang
                AND o.source IS NOT DISTINCT FROM t.source
            JOIN f l ON l.level = 'l' AND l.rule = t.rule AND l.lang IS NOT DISTINCT FROM t.lang
            JOIN f a ON a.level = 'a' AND a.rule = t.rule GROUP BY t.r)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(fits, false) AS kept FROM v LEFT JOIN j USING (r)"""


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op12_lexical_search": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
        sized AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
        q AS MATERIALIZED (SELECT DISTINCT i, item_id, unnest({_TERMS}) AS term
            FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
        tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d)
            WHERE term IN (SELECT term FROM q) GROUP BY r, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
        v AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part
            FROM tf JOIN sized USING (r) JOIN w USING (term), totals),
        s AS (SELECT i, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN v USING (term) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i
            ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {lexical_search.TOP}""",
    "op11_quality_rules": _quality_sql(),
    "op3_exact_dedup": """WITH n AS (SELECT doc_id, translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    "op9_line_dedup": rf"""WITH p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id,
            lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
            trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
                '{lines._HIDDEN}', '', 'g'), '{lines._BLOCK}', chr(10), 'g'), '{lines._TAG}', '', 'g'),
                '\n[\n \t]*', chr(10), 'g'), chr(10) || chr(32) || chr(9)) AS text FROM pages),
        l AS MATERIALIZED (SELECT r, host, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
            FROM (SELECT r, host, string_split(text, chr(10)) AS parts FROM p)),
        k AS MATERIALIZED (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS key FROM l),
        t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
        b AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT r) AS n FROM k WHERE key <> ''
            GROUP BY host, key) JOIN t USING (host) WHERE n > total * {lines.RATIO}
            AND (n >= {lines.MIN_PAGES} OR (n >= 2 AND n = total))),
        m AS (SELECT k.*, b.key IS NOT NULL AS bad FROM k LEFT JOIN b ON k.host = b.host AND k.key = b.key),
        s AS (SELECT r, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE bad) AS n_bad,
            string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad) AS rest FROM m GROUP BY r)
        SELECT page_id, host, coalesce(n_lines, 0) AS n_lines,
            CASE WHEN n_bad < n_lines THEN n_bad ELSE 0 END AS n_dropped,
            sha256(CASE WHEN n_bad > 0 AND n_bad < n_lines THEN rest ELSE text END) AS text_sha256
        FROM p LEFT JOIN s USING (r)""",
}
