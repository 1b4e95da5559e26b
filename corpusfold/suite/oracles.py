"""The same results in plain SQL (DuckDB dialect) over the same tables."""

from __future__ import annotations

from corpusfold.functions.stopwords import ENGLISH
from corpusfold.suite.queries import EXTENSIONS, GLOBS, KS, LETTERS, MAX_FRAMES, SOURCE_DIR, TARGET_DIR


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


PATH = "CAST(doc_id AS VARCHAR) || '.txt'"
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


URLS = """
urls AS (SELECT page_id, replace(replace(replace(regexp_replace(url, '^https?://', ''),
    '/fr/', '/.git/'), '/de/', '/node_modules/'), '/es/', '/__pycache__/') AS rel_path FROM pages)"""

TAGS = """
tags AS (SELECT CAST(c_custkey AS VARCHAR) AS path,
    CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS title, c_mktsegment AS artist,
    CASE WHEN c_nationkey < 5 THEN NULL ELSE n_name END AS album
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
tag_texts AS (SELECT path, artist, concat_ws(' ', nullif(title, ''), nullif(artist, ''), nullif(album, ''))
    AS tags_text FROM tags)"""

TRANSCRIPTS = f"""
joined AS (SELECT CAST(conv_id AS VARCHAR) AS path,
    {_strip("coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE text <> ''), '')")} AS t
    FROM conversations GROUP BY conv_id),
transcripts AS (SELECT path, CASE WHEN length(t) > 2000 THEN substring(t, 1, 2000) || '...'
    ELSE nullif(t, '') END AS transcript FROM joined)"""

PLACED = f"""
placed AS (SELECT doc_id, {PATH} AS path, source,
    'Topic_' || regexp_extract(source, '(\\d)$', 1) AS folder FROM documents)"""

LISTING = f"""
listing AS (
    SELECT '{SOURCE_DIR}/' || p.path AS path FROM placed p LEFT JOIN labels l ON p.doc_id = l.doc_id
    WHERE coalesce(toxic, 0) = 0
    UNION ALL
    SELECT '{TARGET_DIR}/' || folder || '/' || p.path FROM placed p JOIN labels l ON p.doc_id = l.doc_id
    WHERE quality = 1)"""

PLAN = f"""{PLACED}, {LISTING},
plan AS (SELECT folder, path, source, destination,
    CASE WHEN source NOT IN (SELECT path FROM listing) THEN 'missing'
         WHEN destination IN (SELECT path FROM listing) THEN 'exists' ELSE 'move' END AS status
    FROM (SELECT folder, path, '{SOURCE_DIR}/' || path AS source,
                 '{TARGET_DIR}/' || folder || '/' || path AS destination FROM placed))"""

# One row per vector and dimension, and labellings: the label itself, or the label modulo k.
CELLS = """
cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def _labellings(ks: str) -> str:
    return f"labellings AS (SELECT vec_id, k, label % k AS cluster FROM embeddings, (SELECT unnest({ks}) AS k))"


SPREADS = """
means AS MATERIALIZED (SELECT k, cluster, i, avg(x) AS m, count(*) AS n
    FROM cells JOIN labellings USING (vec_id) GROUP BY k, cluster, i),
centre AS (SELECT i, avg(x) AS m FROM cells GROUP BY i),
within_ AS (SELECT k, sum((x - m) * (x - m)) AS w FROM cells JOIN labellings USING (vec_id)
    JOIN means USING (k, cluster, i) GROUP BY k),
between_ AS (SELECT k, sum(n * (means.m - centre.m) * (means.m - centre.m)) AS b,
    count(DISTINCT cluster) AS groups FROM means JOIN centre USING (i) GROUP BY k),
spreads AS (SELECT k, w AS distortion,
    (b / (groups - 1)) / (w / ((SELECT count(*) FROM embeddings) - groups)) AS calinski
    FROM within_ JOIN between_ USING (k))"""


def _silhouettes(distance: str) -> str:
    return f"""
vectors AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS other, {distance} AS d
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id),
sides AS (SELECT k, own.vec_id, own.cluster = theirs.cluster AS same, theirs.cluster AS c, avg(d) AS d
    FROM pairs JOIN labellings own ON pairs.vec_id = own.vec_id
    JOIN labellings theirs USING (k) WHERE theirs.vec_id = pairs.other
    GROUP BY k, own.vec_id, same, c),
scored AS (SELECT k, vec_id, max(d) FILTER (WHERE same) AS a, min(d) FILTER (WHERE NOT same) AS b
    FROM sides GROUP BY k, vec_id),
silhouettes AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
    FROM scored GROUP BY k)"""


EUCLIDEAN = "list_distance(a.e, b.e)"
SQUARED = "list_distance(a.e, b.e) * list_distance(a.e, b.e)"
SWEEP = f"{CELLS}, {_labellings(f'range({KS[0]}, {KS[-1] + 1})')}, {SPREADS}, {_silhouettes(SQUARED)}"

STOP = f"(word IN ({_quoted(ENGLISH)}) OR length(word) < 3)"
WORDS = r"""
split_ AS (SELECT doc_id, lang AS cluster, list_filter(list_transform(
    string_split_regex(text, '[.!?]+(?:[ \t\n\f\r]+|\z)|\n+'),
    lambda s: regexp_extract_all(s, '[\p{L}\p{M}\p{N}]+|[,;:()\[\]{}"]')), lambda w: len(w) > 0) AS parts
    FROM documents),
sentences AS MATERIALIZED (SELECT doc_id, cluster, generate_subscripts(parts, 1) - 1 AS sentence,
    unnest(parts) AS words FROM split_),
tokens AS MATERIALIZED (SELECT doc_id, cluster, sentence, place, raw, word, acronym,
    place > 0 AND NOT acronym AND initial = upper(initial) AND initial <> lower(initial) AS proper,
    raw IN (',', ';', ':', '(', ')', '[', ']', '{', '}', '"') AS is_break,
    lead(raw) OVER w AS raw_next, lead(word) OVER w AS next_word
    FROM (SELECT *, lower(raw) AS word, substring(raw, 1, 1) AS initial,
            raw = upper(raw) AND raw <> lower(raw) AND length(raw) > 1 AS acronym
          FROM (SELECT doc_id, cluster, sentence, generate_subscripts(words, 1) - 1 AS place,
                  unnest(words) AS raw FROM sentences))
    WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY place)),
plain AS MATERIALIZED (SELECT * FROM tokens WHERE NOT is_break),
pairs AS MATERIALIZED (SELECT cluster, word AS w0, next_word AS w1, count(*) AS n FROM plain
    WHERE raw_next NOT IN (',', ';', ':', '(', ')', '[', ']', '{', '}', '"') GROUP BY ALL),
places AS (SELECT cluster, word, count(*) AS sentences, quantile_cont(sentence, 0.5) AS median_sentence
    FROM (SELECT DISTINCT cluster, word, doc_id, sentence FROM plain) GROUP BY cluster, word),
counts AS (SELECT cluster, word, count(*) AS tf, count(*) FILTER (WHERE proper) AS proper,
    count(*) FILTER (WHERE acronym) AS acronym FROM plain GROUP BY cluster, word),
lefts AS (SELECT cluster, w1 AS word, count(*) AS words, sum(n) AS total FROM pairs GROUP BY ALL),
rights AS (SELECT cluster, w0 AS word, count(*) AS words, sum(n) AS total FROM pairs GROUP BY ALL),
stats AS MATERIALIZED (SELECT cluster, word, tf, proper, acronym, sentences,
    CAST(coalesce(l.words, 0) AS BIGINT) AS left_words, CAST(coalesce(l.total, 0) AS BIGINT) AS left_total,
    CAST(coalesce(r.words, 0) AS BIGINT) AS right_words, CAST(coalesce(r.total, 0) AS BIGINT) AS right_total,
    CAST(median_sentence AS DOUBLE) AS median_sentence
    FROM counts JOIN places USING (cluster, word) LEFT JOIN lefts l USING (cluster, word)
    LEFT JOIN rights r USING (cluster, word))"""
SCORES = rf"""{WORDS},
totals AS (SELECT cluster, avg(CAST(tf AS DOUBLE)) FILTER (WHERE NOT {STOP}) AS mean_tf,
    stddev_pop(CAST(tf AS DOUBLE)) FILTER (WHERE NOT {STOP}) AS sd_tf, max(tf) AS max_tf
    FROM stats GROUP BY cluster),
lengths AS (SELECT cluster, count(*) AS n FROM sentences GROUP BY cluster),
features AS (SELECT s.cluster, word, tf, {STOP} AS stop,
    greatest(proper, acronym) / (1 + ln(tf)) AS case_, ln(ln(3 + median_sentence)) AS position,
    tf / (mean_tf + sd_tf) AS frequency, sentences / CAST(n AS DOUBLE) AS spread,
    1 + (CASE WHEN left_total > 0 THEN left_words / CAST(left_total AS DOUBLE) ELSE 0 END
       + CASE WHEN right_total > 0 THEN right_words / CAST(right_total AS DOUBLE) ELSE 0 END) * tf / max_tf AS related
    FROM stats s JOIN totals USING (cluster) JOIN lengths USING (cluster)),
terms AS MATERIALIZED (SELECT cluster, word, tf, stop,
    related * position / (case_ + frequency / related + spread / related) AS s FROM features),
usable AS MATERIALIZED (SELECT cluster, word, tf, s, cluster || ' ' || word AS key FROM terms WHERE NOT stop AND NOT regexp_matches(word, '^\p{{N}}+$')),
candidates AS MATERIALIZED (
    SELECT cluster, word AS keyword, 1 AS size, tf, ln(s / (tf * (1 + s))) AS log_score FROM usable
    UNION ALL
    SELECT p.cluster, w0 || ' ' || w1, 2, n, ln(a.s * b.s / (n * (1 + a.s + b.s)))
    FROM (SELECT *, cluster || ' ' || w0 AS key0, cluster || ' ' || w1 AS key1 FROM pairs) p
    JOIN usable a ON a.key = key0 JOIN usable b ON b.key = key1),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (
    PARTITION BY cluster ORDER BY round(log_score, 9), keyword) AS rank FROM candidates)"""

# The hash Spark's HashingTF applies to a word (Murmur3, 32 bits, seed 42), on the word's bytes in hex.
MASK = "4294967295"


def _turn(value: str, bits: int) -> str:
    return f"(((({value}) << {bits}) | (({value}) >> {32 - bits})) & {MASK})"


def _times(value: str, factor: int) -> str:
    return f"((({value}) * {factor}::UBIGINT) & {MASK})"


def _mixed(value: str) -> str:
    return _times(_turn(_times(value, 0xCC9E2D51), 15), 0x1B873593)


def _byte(at: str) -> str:
    return f"('0x' || substring(bytes, 2 * ({at}) + 1, 2))::UBIGINT"


BUCKETS = f"""
words AS MATERIALIZED (SELECT path, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM
    (SELECT {PATH} AS path, repeat({PATH}, 2) || ' ' || text AS text FROM documents)),
spelled AS MATERIALIZED (SELECT word, hex(word) AS bytes, len(hex(word)) // 2 AS n FROM (SELECT DISTINCT word FROM words)),
blocks AS MATERIALIZED (SELECT word, n, list_reduce(list_prepend(42::UBIGINT, list_transform(range(n // 4), lambda i:
        {_byte('4 * i')} + {_byte('4 * i + 1')} * 256 + {_byte('4 * i + 2')} * 65536 + {_byte('4 * i + 3')} * 16777216)),
    lambda h, k: ({_turn(f"xor(h, {_mixed('k')})", 13)} * 5 + 3864292196) & {MASK}) AS h,
    CASE WHEN n % 4 > 0 THEN {_byte('n - n % 4')} ELSE 0 END
      + CASE WHEN n % 4 > 1 THEN {_byte('n - n % 4 + 1')} * 256 ELSE 0 END
      + CASE WHEN n % 4 > 2 THEN {_byte('n - n % 4 + 2')} * 65536 ELSE 0 END AS tail FROM spelled),
ends AS MATERIALIZED (SELECT word, xor(xor(h, {_mixed('tail')}), n::UBIGINT) AS h FROM blocks),
ends1 AS MATERIALIZED (SELECT word, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM ends),
ends2 AS MATERIALIZED (SELECT word, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM ends1),
hashed AS MATERIALIZED (SELECT word, CAST(xor(h, h >> 16) % 1024 AS INTEGER) AS bucket FROM ends2),
counts AS MATERIALIZED (SELECT path, bucket, count(*) AS tf FROM words JOIN hashed USING (word) GROUP BY ALL),
weights AS MATERIALIZED (SELECT path, bucket, tf * ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1)) AS w
    FROM counts JOIN (SELECT bucket, count(*) AS df FROM counts GROUP BY bucket) USING (bucket)),
norms AS (SELECT path, sqrt(sum(w * w)) AS norm FROM weights GROUP BY path)"""

DISTINCT = f"""{SCORES},
orders AS (SELECT cluster, list([keyword] ORDER BY rank) AS phrases FROM ranked GROUP BY cluster),
kept AS (SELECT cluster, list_reduce(list_prepend(CAST([] AS VARCHAR[]), phrases), lambda kept, p:
    CASE WHEN len(kept) >= 5 OR len(list_filter(kept, lambda k:
        1 - levenshtein(k, p[1]) / CAST(greatest(length(k), length(p[1])) AS DOUBLE) > 0.9)) > 0
    THEN kept ELSE list_concat(kept, p) END) AS kept FROM orders),
chosen AS (SELECT cluster, CAST(generate_subscripts(kept, 1) AS INTEGER) AS place, unnest(kept) AS keyword FROM kept)"""

# Units as documents: all files of a source as one text.
UNIT_TEXTS = f"""unit_texts AS MATERIALIZED (SELECT source AS doc_id, source AS lang,
    string_agg({PATH} || text, '' ORDER BY source || '/' || {PATH}) AS text FROM documents GROUP BY source)"""
TREE_TEXT = _strip(r"regexp_replace(text, '\r\n?', chr(10), 'g')")
TOPIC = r"'Topic_' || regexp_extract(source, '(\d)$', 1)"

# Phrases of three words: the middle one counts by its score, or as a stop word by how firmly it is bound to its neighbours.
TRIPLES = rf"""{SCORES},
runs AS MATERIALIZED (SELECT cluster, is_break, raw_next, word AS w0, next_word AS w1, lead(word, 2) OVER w AS w2,
    lead(raw, 2) OVER w AS raw_third FROM tokens WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY place)),
triples AS MATERIALIZED (SELECT cluster, w0, w1, w2, count(*) AS n FROM runs WHERE NOT is_break AND w2 IS NOT NULL
    AND raw_next NOT IN (',', ';', ':', '(', ')', '[', ']', '{{', '}}', '"')
    AND raw_third NOT IN (',', ';', ':', '(', ')', '[', ']', '{{', '}}', '"')
    AND NOT regexp_matches(w1, '^\p{{N}}+$') GROUP BY ALL),
parts AS (SELECT t.*, a.s AS s0, b.s AS s1, c.s AS s2, b.stop AS stop, (p.n / a.tf::DOUBLE) * (q.n / c.tf::DOUBLE) AS bound
    FROM triples t JOIN usable a ON a.cluster = t.cluster AND a.word = t.w0 JOIN terms b ON b.cluster = t.cluster AND b.word = t.w1
    JOIN usable c ON c.cluster = t.cluster AND c.word = t.w2
    JOIN pairs p ON p.cluster = t.cluster AND p.w0 = t.w0 AND p.w1 = t.w1
    JOIN pairs q ON q.cluster = t.cluster AND q.w0 = t.w1 AND q.w1 = t.w2)"""

ORACLES: dict[str, str] = {
    "corpus_scan": f"SELECT {PATH} AS path, text AS content FROM documents",
    "noise_filter": f"""WITH {URLS} SELECT page_id, rel_path FROM urls
        WHERE len(list_filter(string_split(rel_path, '/'), lambda c: starts_with(c, '.')
              OR c IN ('__pycache__', 'node_modules'))) = 0""",
    "exclude_glob": f"""WITH {URLS} SELECT page_id, rel_path FROM urls
        WHERE len(list_filter(string_split(rel_path, '/'),
              lambda c: {' OR '.join(f"c GLOB '{g}'" for g in GLOBS)})) = 0""",
    "ext_class": rf"""WITH names AS (SELECT doc_id, CASE WHEN lang = 'es' THEN '.' ELSE '' END
            || CAST(doc_id AS VARCHAR) || list_extract([{_quoted(EXTENSIONS)}], doc_id % {len(EXTENSIONS)} + 1) AS name
            FROM documents),
        found AS (SELECT doc_id, name, lower(regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1)) AS ext FROM names)
        SELECT doc_id, name, ext, CASE WHEN ext IN ('.pdf', '.txt', '.docx', '.xml') THEN 'readable'
            WHEN ext IN ('.mp3', '.wav', '.flac', '.aac', '.ogg', '.wma', '.m4a', '.aiff', '.opus') THEN 'audio'
            ELSE 'other' END AS kind FROM found""",
    "unit_rollup": f"""SELECT source AS unit, 0 AS part, 1 AS parts,
        string_agg({PATH} || text, '' ORDER BY source || '/' || {PATH}) AS content FROM documents GROUP BY source""",
    "weighted_text": f"""SELECT {PATH} AS path, repeat({PATH}, 3) || CASE WHEN lang = 'es' THEN ''
        WHEN lang = 'de' THEN ' ' ELSE ' ' || text END AS text FROM documents""",
    "skip_organized": f"""SELECT {PATH} AS unit, source FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "organized_folders": """SELECT DISTINCT lang || '_' || quality AS folder
        FROM documents JOIN labels USING (doc_id)""",
    "tags_text": f"WITH {TAGS} SELECT path, tags_text FROM tag_texts",
    "duration_cap": f"""WITH heard AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn AS seq,
            CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS frames_read
            FROM conversations)
        SELECT * FROM heard WHERE frames_read <= {MAX_FRAMES}""",
    "transcript": f"WITH {TRANSCRIPTS} SELECT path, transcript FROM transcripts",
    "audio_content": f"""WITH {TAGS}, {TRANSCRIPTS}
        SELECT CAST(c_custkey AS VARCHAR) AS path,
            nullif(concat_ws(' ', nullif(tags_text, ''), nullif(transcript, '')), '') AS content
        FROM customer LEFT JOIN (SELECT * FROM tag_texts WHERE artist <> 'BUILDING') t
            ON t.path = CAST(c_custkey AS VARCHAR)
        LEFT JOIN transcripts s ON s.path = CAST(c_custkey AS VARCHAR)""",
    "embedding_join": """SELECT doc_id AS path, CAST(len(embedding) AS INTEGER) AS dims,
        round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "cluster_inertia": f"""WITH {CELLS}, {_labellings('[10]')}, {SPREADS}
        SELECT k, round(distortion, 6) AS distortion FROM spreads""",
    "calinski_harabasz": f"""WITH {CELLS}, {_labellings('[10]')}, {SPREADS}
        SELECT k, round(calinski, 6) AS calinski FROM spreads""",
    "silhouette_exact": f"""WITH {_labellings('[10]')}, {_silhouettes(EUCLIDEAN)}
        SELECT k, round(silhouette, 6) AS silhouette FROM silhouettes""",
    "silhouette_sampled": f"""WITH {_labellings('[10]')}, {_silhouettes(EUCLIDEAN)}
        SELECT k, round(silhouette, 6) AS silhouette, true AS rough_within FROM silhouettes""",
    "kmeans_checks": """SELECT count(*) AS rows, 5::BIGINT AS clusters, 4 AS span, true AS cost_is_inertia,
        true AS best_of_restarts FROM embeddings""",
    "silhouette_squared": f"""WITH {_labellings('[10]')}, {_silhouettes(SQUARED)}
        SELECT k, round(silhouette, 6) AS silhouette FROM silhouettes""",
    "kmeans_assign": f"""WITH {CELLS},
        means AS (SELECT label AS cluster, i, avg(x) AS m FROM cells GROUP BY label, i),
        away AS (SELECT vec_id, cluster, sum((x - m) * (x - m)) AS d
            FROM cells JOIN means USING (i) GROUP BY vec_id, cluster)
        SELECT vec_id, arg_min(cluster, d) AS cluster FROM away GROUP BY vec_id""",
    "sweep_metrics": f"""WITH {SWEEP} SELECT CAST(k AS INTEGER) AS k, round(distortion, 6) AS distortion,
        round(silhouette, 6) AS silhouette, round(calinski, 6) AS calinski
        FROM spreads JOIN silhouettes USING (k)""",
    "select_k": f"""WITH {SWEEP},
        metrics AS MATERIALIZED (SELECT k, distortion, silhouette, calinski,
            lead(distortion, 2) OVER (ORDER BY k) - 2 * lead(distortion) OVER (ORDER BY k) + distortion AS bend
            FROM spreads JOIN silhouettes USING (k)),
        chosen AS (
            SELECT arg_max(k, silhouette) AS k, 0 AS priority FROM metrics
            UNION ALL SELECT arg_max(k, calinski), 1 FROM metrics
            UNION ALL SELECT arg_min(k, bend), 2 FROM metrics WHERE bend IS NOT NULL),
        votes AS (SELECT k, count(*) AS n, min(priority) AS priority FROM chosen GROUP BY k)
        SELECT CAST(least(greatest(k, 2), (SELECT count(*) FROM embeddings) - 1) AS INTEGER) AS k
        FROM votes ORDER BY n DESC, priority LIMIT 1""",
    "term_stats": f"""WITH {WORDS} SELECT cluster, word AS term, tf, proper, acronym, sentences,
        left_words, left_total, right_words, right_total, median_sentence FROM stats""",
    "keyword_scores": f"""WITH {SCORES} SELECT cluster, keyword, size, tf,
        round(log_score, 6) AS log_score FROM candidates""",
    "keyword_scores_three": f"""WITH {TRIPLES} SELECT cluster, w0 || ' ' || w1 || ' ' || w2 AS keyword, n AS tf,
        round(ln(s0 * CASE WHEN stop THEN 2 - bound ELSE s1 END * s2
            / (n * (1 + s0 + CASE WHEN stop THEN bound - 1 ELSE s1 END + s2))), 6) AS log_score FROM parts""",
    "keyword_topk": f"""WITH {SCORES} SELECT cluster, CAST(rank AS INTEGER) AS rank, keyword,
        round(log_score, 6) AS log_score FROM ranked WHERE rank <= 25""",
    "keyword_distinct": f"""WITH {DISTINCT}
        SELECT cluster, place AS rank, keyword, round(log_score, 6) AS log_score
        FROM chosen JOIN ranked USING (cluster, keyword)""",
    "embed_tfidf": f"""WITH {BUCKETS} SELECT path, bucket,
        round(CASE WHEN norm > 0 THEN w / norm ELSE w END, 6) AS weight FROM weights JOIN norms USING (path)""",
    "folder_name": f"""WITH {SCORES},
        best AS (SELECT cluster, replace(string_agg(keyword, '_' ORDER BY rank), ' ', '_') AS name
            FROM ranked WHERE rank <= 2 GROUP BY cluster),
        clusters AS (SELECT DISTINCT lang AS cluster FROM documents
            UNION ALL SELECT max(lang) || '-none' FROM documents)
        SELECT cluster, coalesce(upper(substring(name, 1, 1)) || lower(substring(name, 2)),
            'Cluster_' || cluster) AS folder FROM clusters LEFT JOIN best USING (cluster)""",
    "folder_merge": f"""WITH {PLACED}, firsts AS (SELECT folder, min(path) AS first_path FROM placed GROUP BY folder),
        numbered AS (SELECT folder, CAST(row_number() OVER (ORDER BY first_path) AS INTEGER) AS folder_order FROM firsts)
        SELECT folder_order, folder, path FROM placed JOIN numbered USING (folder)""",
    "structure_summary": f"""WITH {PLACED} SELECT folder, count(*) AS documents, min(path) AS first_path,
        max(path) AS last_path FROM placed GROUP BY folder""",
    "organize_plan": f"WITH {PLAN} SELECT folder, path, source, destination, status FROM plan",
    "undo_plan": f"""WITH {PLAN} SELECT source, destination,
        CASE WHEN destination NOT IN (SELECT path FROM listing) THEN 'missing'
             WHEN source IN (SELECT path FROM listing) THEN 'conflict' ELSE 'restore' END AS status FROM plan""",
    "apply_plan": f"""WITH {PLAN} SELECT doc_id, CASE WHEN status = 'move' THEN destination ELSE plan.source END AS location
        FROM placed JOIN plan USING (path)""",
    "undo_roundtrip": f"SELECT doc_id, '{SOURCE_DIR}/' || {PATH} AS location FROM documents",
    "manifest": f"WITH {PLAN} SELECT source, destination FROM plan WHERE status = 'move'",
    "write_folders": f"""WITH {PLACED} SELECT folder, count(*) AS documents,
        CAST(sum(length(text)) AS BIGINT) AS chars FROM placed JOIN documents USING (doc_id) GROUP BY folder""",
    "undo_repeated": f"SELECT doc_id, '{SOURCE_DIR}/' || {PATH} AS location FROM documents",
    "decode_bytes": rf"""SELECT doc_id, CASE WHEN lang = 'es' AND doc_id % 5 = 0 AND text <> '' THEN NULL
        ELSE {_strip(r"regexp_replace(text, '\r\n?', chr(10), 'g')")} END AS content FROM documents""",
    "analyze_vectors_paths": f"SELECT {PATH} AS path FROM documents",
    "docx_lines": r"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(
        regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x09\x0b-\x1f]', ' ', 'g'), chr(10)),
        lambda s: s <> ''), chr(10)) AS content FROM documents""",
    "tree_scan": rf"""SELECT source AS path, 0 AS part, 1 AS parts, string_agg({PATH}
        || {_strip(r"regexp_replace(text, '\r\n?', chr(10), 'g')")}, '' ORDER BY source || '/' || {PATH}) AS content
        FROM documents GROUP BY source""",
    "tree_scan_parts": f"""SELECT source AS path, string_agg({PATH} || {TREE_TEXT}, '' ORDER BY source || '/' || {PATH}) AS content,
        true AS numbered, true AS whole_sentences FROM documents GROUP BY source""",
    "unit_rollup_parts": f"""WITH {UNIT_TEXTS} SELECT doc_id AS unit, text AS content, true AS numbered,
        true AS whole_sentences FROM unit_texts""",
    "term_stats_parts": f"""WITH {UNIT_TEXTS}, {WORDS.replace('FROM documents)', 'FROM unit_texts)')}
        SELECT cluster, word AS term, tf, proper, acronym, sentences,
        left_words, left_total, right_words, right_total, median_sentence FROM stats""",
    "embed_encoder_parts": f"""WITH {UNIT_TEXTS} SELECT doc_id AS path, {', '.join(
        f"round((length(text) - length(replace(text, '{c}', ''))) / length(text)::DOUBLE, 4) AS share_{c}" for c in LETTERS)}
        FROM unit_texts""",
    "rescan_organized": f"""SELECT 'scanned' AS kind, source AS name, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS size
        FROM documents GROUP BY source
        UNION ALL SELECT 'written', {TOPIC}, count(DISTINCT source), CAST(sum(length({PATH} || {TREE_TEXT})) AS BIGINT)
        FROM documents GROUP BY {TOPIC}
        UNION ALL SELECT 'moved', {TOPIC}, count(DISTINCT source), NULL FROM documents GROUP BY {TOPIC}""",
    "undo_chain": f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '/run1/' || {TOPIC} || '/' || {PATH} ELSE '/run0/' || {PATH} END
        AS location FROM documents
        UNION ALL SELECT -1 - doc_id, '/run0/' || {PATH} FROM documents WHERE doc_id % 7 = 0""",
    "tree_extractors": f"""SELECT doc_id || CASE WHEN lang = 'en' THEN '.rev' ELSE '.txt' END AS path,
        sha256(CASE WHEN lang = 'en' THEN text ELSE {TREE_TEXT} END) AS content_sha256 FROM documents""",
    "prepared_stream": f"""SELECT source || '/' || {PATH} AS rel_path, source AS unit, {PATH} AS name, '.txt' AS ext, 'readable' AS kind,
        repeat({PATH}, 3) || ' ' || text AS text FROM documents WHERE doc_id % 10 <> 7""",
    "candidate_range": """WITH counts AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 5)) c(i, n)
            UNION ALL SELECT 5, count(*) FROM embeddings WHERE label < 1 UNION ALL SELECT 6, count(*) FROM embeddings WHERE label < 5
            UNION ALL SELECT 7, count(*) FROM embeddings WHERE label < 10)
        SELECT CAST(i AS INTEGER) AS "case", CAST(k AS INTEGER) AS k FROM counts, range(2, 11) r(k) WHERE k <= n - 1""",
    "analyze_documents_paths": f"SELECT {PATH} AS path, 1::BIGINT AS places FROM documents",
}
