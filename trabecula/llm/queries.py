"""The registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import A_Z, LOWER_A_Z, table
from .exact_dedup import exact_dedup
from .licenses import MOSTLY, OTHER, THRESHOLD, license_scan, template_counts
from .mixing import BLOCK_WORDS, MOST, RANGES, SEED, WEIGHTS, mix
from .near_dups import THRESHOLD as THRESHOLD_J, N, near_duplicates
from .neighbours import nearest
from .pieces import encode
from .quality import quality_scores
from .scoring import lm_scores
from .secrets import secret_scan
from .substring_dedup import WINDOW, substring_dedup


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_pieces", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source, in it one for each thousand ids."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = license_scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return out.withColumnRenamed("file_id", "doc_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_source_mix": op5_source_mix,
    "op6_lm_scores": op6_lm_scores,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

_TERMS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_TEMPLATES = ", ".join(f"('{name}', '{t}', {n})" for name, counts in template_counts().items() for t, n in counts.items())

#: Words with their places, from 1.
_WORDS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w)"""

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE {_WORDS},
        r AS (SELECT doc_id, string_agg(word, ' ') OVER x AS gram, count(*) OVER x AS n FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING)),
        g AS (SELECT DISTINCT doc_id, gram FROM r WHERE n = {N} UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {N - 1}),
        d AS (SELECT w.doc_id, coalesce(s, []) AS s FROM w LEFT JOIN (SELECT doc_id, list_sort(list(gram)) AS s FROM g GROUP BY doc_id) USING (doc_id)),
        k AS (SELECT s, min(doc_id) AS set_id, count(*) AS n_copies, len(s) AS size FROM d GROUP BY s),
        e AS (SELECT set_id, size, gram FROM k JOIN g ON doc_id = set_id),
        l AS (SELECT a.set_id AS a, b.set_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.set_id <> b.set_id
            GROUP BY a.set_id, b.set_id, a.size, b.size HAVING count(*) * {1 + THRESHOLD_J} >= {THRESHOLD_J} * (a.size + b.size) - 1e-6),
        c AS (SELECT set_id AS id, set_id AS root FROM k UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id),
        m AS (SELECT id, min(root) AS class_id FROM c GROUP BY id)
        SELECT d.doc_id, m.class_id, k.set_id, k.n_copies, (SELECT count(*) FROM l WHERE l.a = k.set_id) AS n_links FROM d JOIN k USING (s) JOIN m ON m.id = k.set_id""",
    "op3_substring_dedup": f"""
        WITH {_WORDS},
        r AS (SELECT doc_id, pos, string_agg(word, ' ') OVER x AS body, count(*) OVER x AS n FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
        late AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth FROM r WHERE n = {WINDOW}) q WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM late),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body FROM p ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
        cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(cut.n, 0) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""",
    "op4_license_scan": f"""
        WITH f AS (SELECT doc_id, concat_ws('/', coalesce(source, 'none'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id AS VARCHAR) || '.txt') AS path,
            concat_ws('/', coalesce(source, 'none'), CAST(doc_id // 1000 AS VARCHAR)) AS dir, text FROM documents),
        tpl(own, term, tf) AS (VALUES {_TEMPLATES}),
        seen AS (SELECT DISTINCT doc_id, unnest({_TERMS.format('text')}) AS term FROM f),
        idf AS (SELECT t.term, ln(((SELECT count(*) FROM f) + 1) / (count(s.doc_id) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM tpl) t LEFT JOIN seen s USING (term) GROUP BY ALL),
        weight AS (SELECT own, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY own)) AS w, idf FROM tpl JOIN idf USING (term)),
        lines AS (SELECT doc_id, length(text) AS size, unnest(range(len(l))) AS line, unnest(l) AS body FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM f WHERE text IS NOT NULL) q),
        tf AS (SELECT doc_id, line, any_value(length(body) / size) AS share, term, count(*) AS tf FROM (SELECT doc_id, line, size, body, unnest({_TERMS.format('body')}) AS term FROM lines) q GROUP BY doc_id, line, term),
        norm AS (SELECT doc_id, line, sqrt(sum((tf.tf * coalesce(idf, {OTHER})) ** 2)) AS norm FROM tf LEFT JOIN idf USING (term) GROUP BY ALL),
        score AS (SELECT doc_id, line, w.own, any_value(share) AS share, round(sum(tf.tf * w.idf * w.w) / any_value(norm), 6) AS score
            FROM tf JOIN weight w USING (term) JOIN norm USING (doc_id, line) GROUP BY doc_id, line, w.own),
        best AS (SELECT * FROM score WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, own) = 1),
        given AS (SELECT dir, own AS given FROM best JOIN f USING (doc_id) WHERE share >= {MOSTLY} QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1)
        SELECT f.doc_id, f.path, b.own, b.score, CAST(b.line AS INT) AS line, coalesce(b.own, g.given) AS license,
          CASE WHEN b.own IS NOT NULL THEN 'own' WHEN g.given IS NOT NULL THEN 'inherited' END AS basis, CASE WHEN b.own IS NULL AND g.given IS NOT NULL THEN f.dir END AS from_dir
        FROM f LEFT JOIN best b USING (doc_id) LEFT JOIN given g USING (dir)""",
    "op5_source_mix": f"""
        WITH {_WORDS},
        z AS (SELECT d.doc_id, d.source, CAST(len(w.ws) AS BIGINT) AS size FROM documents d JOIN w USING (doc_id)),
        o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_id FROM z GROUP BY source),
        b AS (SELECT *, CAST({list(WEIGHTS)}[(source_id - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight FROM o),
        v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY {MOST} * source_size / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
        t AS (SELECT source, source_id, source_size, least(CAST({MOST} * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM v),
        n AS (SELECT source_id, CAST(ceil(round(target) / {BLOCK_WORDS}) AS BIGINT) AS blocks, CAST(sum(CAST(ceil(round(target) / {BLOCK_WORDS}) AS BIGINT)) OVER (ORDER BY source_id) AS BIGINT) AS hi FROM t),
        bits AS (SELECT greatest(1, length(ltrim(bin(max(hi) - 1), '0'))) AS bits FROM n),
        points AS (SELECT slot, list_sum(list_transform(range(bits), lambda i: ((slot >> CAST(i AS INT)) & 1) << CAST(bits - 1 - i AS INT))) AS point FROM (SELECT bits, unnest(range(1 << CAST(bits AS INT))) AS slot FROM bits) q),
        slots AS (SELECT slot, source_id, row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS block FROM points JOIN n ON point >= hi - blocks AND point < hi),
        h AS (SELECT z.doc_id, z.size, t.source_id, t.source_size, t.target, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(z.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
            FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
        s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source_id ORDER BY (h >> 40) % {RANGES}, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM h),
        turns AS (SELECT doc_id, source_id, start + turn * source_size AS lo, least(start + turn * source_size + size, CAST(round(target) AS BIGINT)) AS hi FROM s, range({MOST}) AS q(turn) WHERE size > 0),
        taken AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS taken FROM turns WHERE lo < hi GROUP BY doc_id),
        first AS (SELECT doc_id, min(slot) AS mix_order FROM (SELECT doc_id, source_id, unnest(range(lo // {BLOCK_WORDS}, (hi - 1) // {BLOCK_WORDS} + 1)) AS block FROM turns WHERE lo < hi) q JOIN slots USING (source_id, block) GROUP BY doc_id)
        SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(taken, 0) AS taken, mix_order FROM s LEFT JOIN taken USING (doc_id) LEFT JOIN first USING (doc_id)""",
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{A_Z}', '{LOWER_A_Z}') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)""",
}
