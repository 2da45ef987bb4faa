"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .common import documents
from .exact_dedup import radix_groups
from .filter_audit import filter_audit
from .fingerprints import fingerprints
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .mixing import mixture_counts
from .packing import pack_documents
from .phrases import collocations
from .pitman_yor import language_scores
from .quality import quality
from .sharding import balanced_shards
from .toxicity import toxicity


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), similarity=Fraction(85, 100))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_groups(documents(spark, sf_dir))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = balanced_shards(documents(spark, sf_dir), n_shards=24)
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5)


def op8_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir), folds=10)


def op9_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup(documents(spark, sf_dir))
    return lines.select("doc_id", "n_lines", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=30, max_words=4, cover=(80, 100), top=2000)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_counts(documents(spark, sf_dir), weights=(1, 2, 3), most=3)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_pitman_yor_scores": op8_pitman_yor_scores,
    "op9_quality_perplexity": op9_quality_perplexity,
    "op10_line_dedup": op10_line_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_source_mixing": op12_source_mixing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), g AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM w
        ), n AS (SELECT doc_id, len(g) AS n FROM g),
        s AS (SELECT doc_id, unnest(g) AS s FROM g),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
        ), g AS (
            SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
        ), t AS (SELECT doc_id, i, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
        n AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM t WHERE line <> ''),
        w AS (SELECT *, lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3 FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
        r AS (
            SELECT doc_id, i, n,
                length(line) >= 150 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AS alone,
                line3 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, n) > 1 AS run
            FROM w
        ), g AS (
            SELECT doc_id, i, alone OR bool_or(run) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM r
        ), k AS (
            SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS removed_lines, coalesce(string_agg(raw, chr(10) ORDER BY t.i) FILTER (gone IS NOT TRUE), '') AS text
            FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id
        )
        SELECT doc_id, n_lines, removed_lines, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM k""",
    "op6_sharding": """
        WITH steps AS (
            SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(b)
        ), tbl AS (SELECT list(v ORDER BY b) AS t FROM steps),
        d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (
            SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
                xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                    lambda c, x: xor(c >> 8, tbl.t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
            FROM d, tbl
        ), p AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s
        ), k AS (
            SELECT doc_id, size, text_crc32, CAST(least(23, floor((2 * upto - size) * 24 / (2 * total))) AS INTEGER) AS shard FROM p
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM k""",
    "op11_phrase_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(k)),
        f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
        held AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND b.words > c.words AND 100 * b.a >= 80 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
        cut AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM held)),
        s AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a) // (x.a + y.a) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
        worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000""",
    "op12_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, (source IS NULL)::INTEGER AS none, coalesce(source, '') AS source FROM documents
        ), line AS (SELECT *, row_number() OVER o - 1 AS row, sum(size) OVER (PARTITION BY none, source ORDER BY doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first FROM d WINDOW o AS (ORDER BY none, source, doc_id, size)),
        s0 AS (SELECT none, source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY none, source) - 1) % 3 + 1 AS weight FROM d GROUP BY none, source),
        s1 AS (
            SELECT *, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights, sum(source_size) OVER o - source_size AS words_before, sum(weight) OVER o - weight AS weight_before
            FROM s0 WINDOW o AS (ORDER BY source_size / weight, none, source ROWS UNBOUNDED PRECEDING)
        ), s2 AS (SELECT *, 3 * source_size * (all_weights - weight_before) <= (all_words - 3 * words_before) * weight AS stops FROM s1),
        s3 AS (SELECT *, min(words_before) FILTER (NOT stops) OVER () AS stopped_words, min(weight_before) FILTER (NOT stops) OVER () AS stopped_weight FROM s2),
        s4 AS (
            SELECT none, source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (all_words - 3 * stopped_words)::DOUBLE * weight / (all_weights - stopped_weight) END AS target,
                greatest(1, least(2048, source_size // 512)) AS b FROM s3
        ), s5 AS (SELECT *, (source_size + b - 1) // b AS blocks FROM s4),
        s AS (SELECT *, CASE WHEN source_size > 0 THEN least(3 * blocks, CAST(floor(target * blocks / source_size + 0.5) AS BIGINT)) ELSE 0 END AS quota FROM s5),
        q AS (SELECT none, source, blocks, quota, CAST(sum(quota) OVER (ORDER BY none, source ROWS UNBOUNDED PRECEDING) - quota AS BIGINT) AS upto, CAST(sum(quota) OVER () AS BIGINT) AS n FROM s),
        draws AS (SELECT place, CAST('0x' || substr(md5('1:draw:' || place), 1, 15) AS BIGINT) % n AS lot FROM (SELECT DISTINCT n FROM q) t, unnest(range(n)) r(place)),
        drawn AS (SELECT place, none, source, quota, blocks, row_number() OVER (PARTITION BY none, source ORDER BY place) - 1 AS k FROM draws JOIN q ON lot >= upto AND lot < upto + quota),
        bal AS (SELECT q.*, (SELECT count(*) FROM drawn x WHERE x.none = q.none AND x.source = q.source) AS c FROM q),
        bal2 AS (SELECT *, sum(greatest(quota - c, 0)) OVER (ORDER BY none, source ROWS UNBOUNDED PRECEDING) - greatest(quota - c, 0) AS under_before FROM bal),
        spare AS (SELECT place, row_number() OVER (ORDER BY none, source, k) - 1 AS number FROM drawn WHERE k >= quota),
        places AS (
            SELECT place, none, source, blocks, k FROM drawn WHERE k < quota
            UNION ALL SELECT place, none, source, blocks, c + number - under_before FROM spare JOIN bal2 ON number >= under_before AND number < under_before + quota - c
        ), turned AS (SELECT *, k // blocks AS e, k % blocks AS i FROM places),
        taken AS (
            SELECT none, source, list_reduce(list_prepend(CAST(i AS BIGINT), range(24)), lambda x, r: CASE WHEN CAST('0x' || substr(md5(
                    '1:swap:' || none || ':' || source || ':' || e || ':' || r || ':' || greatest(x, (CAST('0x' || substr(md5('1:turn:' || none || ':' || source || ':' || e || ':' || r), 1, 15) AS BIGINT) % blocks - x + blocks) % blocks)
                ), 1, 15) AS BIGINT) % 2 = 1 THEN (CAST('0x' || substr(md5('1:turn:' || none || ':' || source || ':' || e || ':' || r), 1, 15) AS BIGINT) % blocks - x + blocks) % blocks ELSE x END) AS block
            FROM turned
        ), times AS (SELECT none, source, block, count(*) AS times FROM taken GROUP BY ALL),
        pieces AS (SELECT line.row, line.none, line.source, first, size, b, unnest(range(CAST(first // b AS BIGINT), CAST((first + size - 1) // b AS BIGINT) + 1)) AS block FROM line JOIN s USING (none, source) WHERE size > 0),
        t AS (SELECT row, CAST(sum((least(first + size, (block + 1) * b) - greatest(first, block * b)) * times) AS BIGINT) AS taken FROM pieces JOIN times USING (none, source, block) GROUP BY row)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM line JOIN s USING (none, source) LEFT JOIN t USING (row)""",
    "op13_filter_audit": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
        ), fails AS (
            SELECT doc_id, part, [f for f in [CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END] if f IS NOT NULL] AS fails FROM w
        ), l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS bad FROM labels GROUP BY doc_id),
        d AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM fails LEFT JOIN l USING (doc_id)),
        orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(o, f)),
        steps AS (SELECT o, s, substr(o, s, 1) AS f FROM orders, (VALUES (1), (2), (3), (4), (5)) v(s) WHERE length(o) = 5),
        x AS (SELECT part, o, s, f, good, bad, list_contains(fails, f) AS fails_it, len(list_filter(fails, lambda y: position(y IN o) < s)) > 0 AS gone, len(fails) = 1 AS one FROM d, steps),
        n AS (
            SELECT part, o, s, f, count(*) FILTER (NOT gone AND NOT fails_it) AS kept, count(*) FILTER (NOT gone AND fails_it) AS removed, count(*) FILTER (gone AND fails_it) AS redundant,
                count(*) FILTER (fails_it AND one) AS unique_fails, count(*) FILTER (NOT gone AND fails_it AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails_it AND bad = 1) AS toxic_lost
            FROM x GROUP BY ALL
        )
        SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM n""",
}
