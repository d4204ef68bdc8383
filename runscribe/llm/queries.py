"""The registered queries of the corpus operators, whole tables in, digests out, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, filter_audit, imatch, langid, line_dedup, minhash, mixing, nearest, packing, spelling, substring_dedup, token_counts, toxicity
from .workspace import read_table

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH rows AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(chr(31), CAST(doc_id AS VARCHAR), md5(text))), 1, 15) AS BIGINT) AS h FROM documents),
     sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS size,
         list_value(3.0, 1.0, 2.0)[CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM rows GROUP BY source),
     total AS (SELECT CAST(sum(size) AS DOUBLE) * 1.5 AS budget, sum(weight) AS weights FROM sources),
     ordered AS (SELECT source, size, weight, size * 2.0 AS cap,
         coalesce(sum(size * 2.0) OVER o, 0.0) AS full_before, coalesce(sum(weight) OVER o, 0.0) AS weight_before,
         row_number() OVER (ORDER BY size * 2.0 / weight, source NULLS LAST) AS place FROM sources WINDOW o AS (ORDER BY size * 2.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     level AS (SELECT arg_min((budget - full_before) / (weights - weight_before), place) FILTER (weight * ((budget - full_before) / (weights - weight_before)) <= cap) AS level FROM ordered, total),
     targets AS (SELECT source, size AS source_size, CAST(CASE WHEN weight * level > cap THEN cap ELSE weight * level END AS DOUBLE) AS target FROM ordered, level),
     plan AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM targets),
     upto AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h RANGE UNBOUNDED PRECEDING) AS running, count(*) OVER (PARTITION BY r.source, r.h) AS n,
         sum(r.size) OVER (PARTITION BY r.source, r.h) AS here
         FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * least(whole + CASE WHEN running <= rest THEN 1 ELSE 0 END, 2) + CASE WHEN running > rest AND running - here <= rest THEN floor((rest - (running - here)) / n) ELSE 0 END AS BIGINT) AS taken
FROM upto
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


OP2_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
     starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
     windows AS (SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + 49), ' ')) AS body FROM starts),
     smallest AS (SELECT body, min(doc_id) AS low FROM windows GROUP BY body),
     repeats AS (SELECT doc_id, s FROM windows JOIN smallest USING (body) WHERE low < doc_id),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM repeats),
     per_doc AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
     flat AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
     kept AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.pos) AS body FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos WHERE g.pos IS NULL GROUP BY f.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(len(p.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM w LEFT JOIN per_doc p USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_collision_counting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
     shingles AS (SELECT DISTINCT doc_id, shingle FROM (
         SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) AS shingle FROM w WHERE len(words) >= 5
         UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4)),
     sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
     common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
     links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
     reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
     parts AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, p.component_id, d.doc_id = p.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN parts p USING (doc_id)
"""

ODD_CONVERSATION = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(odd)))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH RECURSIVE lines AS (SELECT doc_id, source, md5(text) AS body, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL),
     keyed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
     sums AS (SELECT * FROM keyed WHERE line <> ''),
     texts AS (SELECT line, body, arg_min(source, doc_id) FILTER (source IS NOT NULL) AS site, min(doc_id) FILTER (source IS NOT NULL) AS low FROM sums GROUP BY line, body),
     open AS (SELECT line FROM texts GROUP BY line HAVING count(DISTINCT site) >= 4),
     bodies AS (SELECT DISTINCT body FROM texts JOIN open USING (line)),
     w AS (SELECT body, any_value(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS words FROM documents JOIN bodies ON md5(text) = body GROUP BY body),
     shingles AS (SELECT DISTINCT body, shingle FROM (
         SELECT body, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) AS shingle FROM w WHERE len(words) >= 5
         UNION ALL SELECT body, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4)),
     sizes AS (SELECT body, count(*) AS n FROM shingles GROUP BY body),
     common AS (SELECT a.body AS a, b.body AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.body <> b.body GROUP BY ALL),
     links AS (SELECT a, b FROM common JOIN sizes x ON x.body = a JOIN sizes y ON y.body = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
     reached AS (SELECT body, body AS other FROM bodies UNION SELECT r.body, l.b FROM reached r JOIN links l ON l.a = r.other),
     near AS (SELECT body, min(other) AS near FROM reached GROUP BY body),
     once AS (SELECT line, near, arg_min(site, low) AS site FROM texts JOIN near USING (body) GROUP BY line, near),
     wide AS (SELECT line FROM once JOIN open USING (line) GROUP BY line HAVING count(DISTINCT site) >= 5),
     firsts AS (SELECT line, arg_min(body, doc_id) AS first_text FROM sums JOIN wide USING (line) GROUP BY line),
     cut AS (SELECT doc_id, pos FROM sums JOIN firsts USING (line) WHERE body <> first_text),
     marked AS (SELECT k.*, c.pos IS NOT NULL AS gone FROM keyed k LEFT JOIN cut c ON k.doc_id = c.doc_id AND k.pos = c.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op9_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op11_even_partition_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
     crc AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
     runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
     own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
     bytes AS (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM own),
     hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
         lambda h, b: xor(h // 256, crc[xor(h, b) % 256 + 1])), 4294967295) AS h FROM bytes, crc),
     results AS (SELECT CASE WHEN h % 199 = 0 THEN run[:CAST(h % length(run) AS INT)] || run[CAST(h % length(run) AS INT) + 2:] ELSE run END AS word, n FROM hashed),
     words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
     cut AS (SELECT word, unnest(range(1, length(word) + 1)) AS place, unnest(list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:])) AS rest FROM words),
     near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
     ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) AS place
                FROM near JOIN words o ON o.word = other),
     formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
                FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
     chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL
"""


def op12_first_failure_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, {WORDS_SQL} AS words FROM documents),
     marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     fails AS (SELECT part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f WHEN 'A' THEN len(words) < 200 WHEN 'B' THEN 100 * len(list_distinct(words)) < 50 * len(words)
             WHEN 'C' THEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) WHEN 'D' THEN regexp_matches(body, '[#$%&*|]')
             ELSE coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY body), false) END) AS failed FROM d LEFT JOIN marks m ON m.doc_id = d.doc_id),
     letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
     orders AS (SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
     steps AS (SELECT array_to_string(o, '') AS filter_order, s.step, o[s.step] AS filter, o[:s.step] AS upto, o[:s.step - 1] AS before FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) s),
     kinds AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, failed),
     counts AS (SELECT part, filter_order, step, filter, sum(n) FILTER (NOT list_has_any(failed, upto)) AS kept,
         sum(n) FILTER (list_contains(failed, filter) AND NOT list_has_any(failed, before)) AS removed, sum(n) FILTER (list_contains(failed, filter) AND list_has_any(failed, before)) AS redundant,
         sum(n) FILTER (failed = [filter]) AS unique_fails, sum(good) FILTER (list_contains(failed, filter) AND NOT list_has_any(failed, before)) AS good_lost,
         sum(toxic) FILTER (list_contains(failed, filter) AND NOT list_has_any(failed, before)) AS toxic_lost FROM kinds, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM counts
"""


def op13_weighted_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing_to_target_weights,
        op2_substring_dedup,
        op3_token_counts,
        op4_collision_counting_neighbours,
        op5_b_bit_minhash,
        op6_chat_format,
        op7_minimum_bin_slack,
        op8_line_dedup,
        op9_i_match,
        op10_language_id,
        op11_even_partition_pigeonhole,
        op12_first_failure_lookup,
        op13_weighted_pattern_grammar,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op1_mixing_to_target_weights": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op5_b_bit_minhash": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_even_partition_pigeonhole": OP11_SQL,
    "op12_first_failure_lookup": OP12_SQL,
}
