"""Queries of the numbered operators over the whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import archive, decontaminate, filter_audit, line_runs, mixing, ngram_join, pairwise_quality, pii, posting_lists, quality_rules, token_scan, toxicity, word_runs
from merchantry.session import new_folder
from merchantry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.plan(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    folder = token_scan.write_tokens(table(spark, sf, "documents"), new_folder(spark, "tokens"))
    return token_scan.count(spark, folder).select("doc_id", "n_tokens")


def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_hash")


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*names)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_pairwise_quality(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise_quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    return line_runs.delete_runs(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op10_content_archive(spark: SparkSession, sf: str) -> DataFrame:
    return archive.round_trip(table(spark, sf, "pages"))


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_word_runs(spark: SparkSession, sf: str) -> DataFrame:
    return word_runs.find(table(spark, sf, "documents"), alter=word_runs.planted)


def op13_posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    return posting_lists.search(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


def queries() -> dict[str, Query]:
    found = (
        op1_mix_sources,
        op2_pii,
        op3_token_counts,
        op4_ngram_join,
        op5_decontaminate,
        op6_quality_rules,
        op7_toxicity,
        op8_pairwise_quality,
        op9_line_runs,
        op10_content_archive,
        op11_filter_audit,
        op12_word_runs,
        op13_posting_lists,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return SQL


SQL = {
    "op1_mix_sources": r"""
        WITH d AS (
          SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
                 CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, 2.0e0 * sum(size) AS cap FROM d GROUP BY skey),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY skey COLLATE C) - 1) % 3
                        WHEN 0 THEN 3.0e0 WHEN 1 THEN 1.0e0 ELSE 2.0e0 END AS weight FROM s),
        l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
                        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
              FROM w WINDOW before AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT skey, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0e0 END AS rate FROM t),
        g AS (SELECT skey, size, count(*) AS n, coalesce(sum(count(*)) OVER (PARTITION BY skey ORDER BY size DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d GROUP BY skey, size),
        c AS (SELECT skey, j, CAST('0x' || substr(md5('mix:' || j || ':' || skey), 1, 8) AS BIGINT) / 4294967296.0e0 AS off
              FROM t, range(0, 64) AS js(j)),
        x AS (SELECT skey, target, j, off, sum(size * (floor((a + n) * rate + off) - floor(a * rate + off))) AS total
              FROM g JOIN q USING (skey) JOIN c USING (skey) GROUP BY ALL),
        o AS (SELECT skey, off FROM x QUALIFY row_number() OVER (PARTITION BY skey ORDER BY abs(total - target), j) = 1),
        r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.rate, o.off,
                     row_number() OVER (PARTITION BY d.skey ORDER BY d.size DESC, d.doc_id % 64, d.doc_id) AS k
              FROM d JOIN q USING (skey) JOIN o USING (skey))
        SELECT doc_id, size, source_size, target,
               CAST(floor(k * rate + off) - floor((k - 1) * rate + off) AS BIGINT) * size AS taken FROM r""",
    "op4_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM
                 (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        df AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM (SELECT * FROM sh SEMI JOIN df USING (s)) a
              JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
              WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
        FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_decontaminate": r"""
        WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        w AS (SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
        sh AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS s FROM
                 (SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT id, count(*) AS n FROM sh WHERE kind = 1 GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, CAST(n.n AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared
        FROM sh d JOIN sh b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
        GROUP BY d.id, b.id, n.n HAVING 100 * count(*) >= 75 * n.n""",
    "op9_line_runs": r"""
        WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        a AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS l, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
              FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x)),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM a WHERE w > 0),
        g AS (SELECT doc_id, pos, k, list(l) OVER v AS ls, sum(w) OVER v AS w, count(*) OVER v AS m
              FROM p, (VALUES (1), (2), (3), (4), (5)) AS ks(k)
              WINDOW v AS (PARTITION BY doc_id, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING)),
        c AS (SELECT doc_id, pos, k, row_number() OVER (PARTITION BY ls ORDER BY doc_id, pos) AS nth
              FROM g WHERE m = k AND w >= 5),
        z AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS pos FROM c WHERE nth > 1),
        del AS (SELECT p.doc_id, p.line_no FROM p JOIN z USING (doc_id, pos))
        SELECT x.doc_id, CAST((SELECT count(*) FROM p WHERE p.doc_id = x.doc_id) AS BIGINT) AS n_lines,
               CAST((SELECT count(*) FROM del WHERE del.doc_id = x.doc_id) AS BIGINT) AS n_deleted,
               coalesce((SELECT string_agg(a.l, chr(10) ORDER BY a.line_no) FROM a
                         WHERE a.doc_id = x.doc_id AND (a.doc_id, a.line_no) NOT IN (SELECT (doc_id, line_no) FROM del)), '') AS text
        FROM x""",
    "op10_content_archive": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN lead END AS refers_to FROM m""",
    "op11_filter_audit": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        m AS (SELECT doc_id, part, CAST(len(ws) < 50 AS INTEGER) AS a, CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INTEGER) AS b,
                     CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS INTEGER) AS c,
                     CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d,
                     CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS INTEGER) AS e FROM w),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        k AS (SELECT part, [a, b, c, d, e] AS f, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
                     a + b + c + d + e AS fails, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
        o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS xs(x)
              WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
        s AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, f[ascii(filter_order[step]) - 64] = 1 AS hit, good, toxic, fails, n,
                     list_sum(list_transform(range(1, step), lambda i: f[ascii(filter_order[i]) - 64])) > 0 AS gone
              FROM k, o, range(1, 6) AS steps(step) WHERE length(filter_order) = 5),
        g AS (SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT coalesce(gone, FALSE)), 0) AS BIGINT) AS kept,
                     CAST(coalesce(sum(n) FILTER (hit AND NOT coalesce(gone, FALSE)), 0) AS BIGINT) AS removed,
                     CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
                     CAST(coalesce(sum(n) FILTER (hit AND fails = 1), 0) AS BIGINT) AS unique_fails,
                     CAST(coalesce(sum(n) FILTER (hit AND good AND NOT coalesce(gone, FALSE)), 0) AS BIGINT) AS good_lost,
                     CAST(coalesce(sum(n) FILTER (hit AND toxic AND NOT coalesce(gone, FALSE)), 0) AS BIGINT) AS toxic_lost
              FROM s GROUP BY part, filter_order, step, x)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g""",
    "op12_word_runs": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        c AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, xor(list_reduce(list_prepend(4294967295, range(0, 8 * length(CAST(doc_id AS VARCHAR)))), lambda x, i:
                     xor(xor(x, if(i % 8 = 0, ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]), 0)) >> 1,
                         3988292384 * (xor(x, if(i % 8 = 0, ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]), 0)) & 1))), 4294967295) AS h FROM d),
        g AS (SELECT *, if(h % 10 = 0 AND n > 0, (h // 10) % n, n) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM c),
        t AS (SELECT doc_id, n, i, ws[1 + if(i < a, i, a + (i - a) % p)] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM g)),
        e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM
                (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k
              HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
        l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
                     arg_min({'s': start, 'l': length, 'p': period}, (-length, start, period)) AS top FROM r GROUP BY doc_id),
        z AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS left_over FROM t ANTI JOIN z USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period,
               CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
        FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
