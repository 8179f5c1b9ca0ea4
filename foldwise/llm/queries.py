"""Registered queries ``op1_* .. op13_*`` and ``pipeline`` with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.collocations import mine_phrases
from foldwise.llm.common import read
from foldwise.llm.conversations import damage, repair_report
from foldwise.llm.decontam import find_leaks
from foldwise.llm.langid import predict_languages
from foldwise.llm.license_scan import scan_licenses
from foldwise.llm.ngram_join import similar_texts
from foldwise.llm.packing import pack_documents
from foldwise.llm.quality_rules import quality_verdicts
from foldwise.llm.sharding import shard_documents
from foldwise.llm.simhash import simhash_classes
from foldwise.llm.suffix_dedup import repeat_report
from foldwise.llm.toxicity import score_toxicity
from foldwise.llm.warc import archive_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


@query()
def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by key; the move to 25 shards beside it."""
    out = shard_documents(read(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS dig FROM p),
     k AS (SELECT dig, max(page_id) AS store FROM d WHERE n >= 1000 GROUP BY dig)
SELECT page_id, n AS payload_bytes, dig AS payload_digest,
       CASE WHEN store IS NULL OR store = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN store IS NULL OR store = page_id THEN NULL ELSE store END AS refers_to
FROM d LEFT JOIN k USING (dig)
""")
def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by the salvage reader."""
    back = archive_pages(read(spark, sf_dir, "pages"))
    return back.filter(F.col("reason").isNull()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
     tri AS (SELECT DISTINCT k, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g, i
             FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
     rep AS (SELECT k, i FROM tri QUALIFY count(*) OVER (PARTITION BY k, g) >= 2),
     cov AS (SELECT k, count(DISTINCT i + s) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS v(s) GROUP BY k),
     dl AS (SELECT k, count(*) - count(DISTINCT l) AS n_dup_lines
            FROM (SELECT DISTINCT ON (k, p) k, p, l FROM
                  (SELECT k, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS p FROM w))
            WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY k),
     pos AS (SELECT DISTINCT source, k, p, lower(l) AS l FROM
             (SELECT source, k, unnest(string_split(t, chr(10))) AS l,
                     unnest(range(len(string_split(t, chr(10))))) AS p FROM w)),
     nl AS (SELECT source, k, p, array_to_string(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), ' ') AS line,
                   len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n FROM pos),
     few AS (SELECT * FROM nl WHERE n >= 1),
     host AS (SELECT source, count(DISTINCT k) AS hd FROM w GROUP BY source),
     freq AS (SELECT f.source, line FROM few f JOIN host h ON f.source IS NOT DISTINCT FROM h.source
              GROUP BY f.source, line, hd HAVING count(DISTINCT k) > 20 AND count(DISTINCT k) > hd * 0.01),
     gone AS (SELECT f.source, k, sum(n) AS removed FROM few f JOIN freq q
              ON f.source IS NOT DISTINCT FROM q.source AND f.line = q.line GROUP BY f.source, k),
     s AS (SELECT doc_id, source, k, len(ws) AS n_words,
                  length(array_to_string(ws, '')) AS word_chars,
                  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
     j AS (SELECT s.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                  coalesce(removed, 0) AS removed
           FROM s LEFT JOIN dl ON s.k = dl.k LEFT JOIN cov ON s.k = cov.k
           LEFT JOIN gone g ON s.k = g.k AND s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       CAST(removed AS BIGINT) AS removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed >= n_words * 0.5 AS kept
FROM j
""")
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the cross-document line rule over all documents."""
    return quality_verdicts(read(spark, sf_dir, "documents"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    return predict_languages(read(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE t AS (SELECT text, row_number() OVER () AS t, ws FROM
       (SELECT DISTINCT text, regexp_extract_all(lower(text), '\\S+') AS ws FROM documents) WHERE len(ws) > 0),
     g AS (SELECT DISTINCT t, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram
           FROM t, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i)),
     c AS (SELECT t, count(*) AS n FROM g GROUP BY t),
     p AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.t <> b.t GROUP BY a.t, b.t),
     e AS (SELECT a, b FROM p JOIN c x ON x.t = a JOIN c y ON y.t = b WHERE p.n >= 0.8 * (x.n + y.n - p.n) - 1e-9),
     reach AS (SELECT t AS a, t AS b FROM t UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
     least AS (SELECT r.a AS t, min(d.doc_id) AS class_id FROM reach r JOIN t ON t.t = r.b JOIN documents d ON d.text = t.text
               GROUP BY r.a),
     links AS (SELECT a AS t, count(*) AS n FROM e GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN least USING (t) LEFT JOIN links USING (t)
""")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return similar_texts(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels that are not held out."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of four permitted lengths."""
    return pack_documents(read(spark, sf_dir, "documents"))


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, with their wording differences."""
    return scan_licenses(read(spark, sf_dir, "documents"))


@query("""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     m AS (SELECT r, list_transform(range(0, length(h) // 2 - 399), lambda i: md5_number(substr(h, 2 * i + 1, 800))) AS ks FROM d),
     w AS (SELECT r, unnest(ks) AS k, unnest(range(0, len(ks))) AS i FROM m),
     dup AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
     cut AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM dup),
     run AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM cut),
     span AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY r, g),
     edge AS (SELECT r, a, b FROM span UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d),
     gap AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS before FROM edge),
     kept AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS t FROM gap JOIN d USING (r) GROUP BY r),
     gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
""")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in 400-byte strings that occur anywhere else."""
    return repeat_report(read(spark, sf_dir, "documents"))


@query()
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or as a paraphrase."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("k1", "k2")


@query("""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
     g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
           FROM w, (VALUES (1), (2), (3), (4)) AS s(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
     c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
     t AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
     q AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k >= 2 AND f >= 30),
     cuts AS (SELECT q.lang, q.k, q.phrase, a, x.k AS c, x.f AS l, y.f AS r,
                    CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
             FROM (SELECT q.*, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp
                   FROM q, unnest(range(1, k)) AS u(cut)) q
             LEFT JOIN c x ON x.lang = q.lang AND x.k = cut AND x.phrase = lp
             LEFT JOIN c y ON y.lang = q.lang AND y.k = q.k - cut AND y.phrase = rp),
     best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
     part AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
              FROM q, (VALUES (2), (3)) AS v(m), unnest(range(1, k - m + 2)) AS u(i) WHERE m < k GROUP BY ALL),
     inner_ AS (SELECT q.lang, q.phrase FROM q JOIN part USING (lang, phrase) WHERE 100 * longer >= 80 * a),
     r AS (SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
           FROM best ANTI JOIN inner_ USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM r JOIN t USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of two to four words of every language."""
    return mine_phrases(read(spark, sf_dir, "documents"))


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and class of near duplicates of every document."""
    return simhash_classes(read(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
     crc AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                 list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
                 lambda x, y: list_reduce(list_prepend(xor(x, y), range(0, 8)),
                     lambda p, k: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)) AS c FROM raw),
     hurt AS (SELECT conv_id, turn, xor(c, 4294967295) % 20 AS hit, role, text FROM crc),
     rows_ AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                      CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
               FROM hurt, (VALUES (0), (1)) AS twice(t) WHERE hit <> 0 AND (t = 0 OR hit = 3)),
     num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS i FROM rows_),
     fault AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
                      NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
                      left(role, 1) AS ini, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS prev FROM num),
     f AS (SELECT *, cut AND NOT blank AND NOT dup AS trunc FROM fault),
     stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     sum(CAST(blank AS INT)) AS blank, sum(CAST(dup AND NOT blank AS INT)) AS duplicate,
                     sum(CAST(trunc AS INT)) AS truncated,
                     sum(CAST(i > 1 AND prev || ini NOT IN ('su', 'ua', 'au') AS INT)) AS illegal, max(i) AS n
              FROM f GROUP BY conv_id),
     ins(s, e, c, w, txt) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
         (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
         (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
     step(s, ini, e) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
     move AS (SELECT conv_id, i, s.s, s.e, CASE WHEN trunc THEN 5 ELSE 0 END AS c, 'K' AS w, chr(10) || role || ':' || text AS txt
              FROM f JOIN step s USING (ini) WHERE NOT blank AND NOT dup
              UNION ALL SELECT conv_id, i, s.s, s.e, CASE WHEN trunc THEN 6 ELSE 1 END, 'R',
                     chr(10) || CASE s.ini WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
              FROM f, step s WHERE NOT blank AND NOT dup AND s.ini IN ('u', 'a')
              UNION ALL SELECT conv_id, i, s.s, s.s, 2, 'D', '' FROM f, (VALUES (0), (1), (2), (3)) AS s(s)),
     v AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, e AS st, c AS cost, w AS audit, txt FROM (SELECT DISTINCT conv_id FROM f), ins WHERE s = 0
           UNION ALL
           SELECT m.conv_id, m.i, ins.e, v.cost + m.c + ins.c, v.audit || m.w || ins.w, v.txt || m.txt || ins.txt
           FROM v JOIN move m ON v.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = v.i + 1 AND m.s = v.st JOIN ins ON ins.s = m.e
           QUALIFY row_number() OVER (PARTITION BY m.conv_id, ins.e ORDER BY v.cost + m.c + ins.c, v.audit || m.w || ins.w) = 1),
     best AS (SELECT v.* FROM v JOIN stat ON v.conv_id IS NOT DISTINCT FROM stat.conv_id AND v.i = stat.n WHERE st IN (0, 3)
              QUALIFY row_number() OVER (PARTITION BY v.conv_id ORDER BY cost, audit) = 1),
     all_ AS (SELECT DISTINCT conv_id FROM conversations)
SELECT all_.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(substr(txt, 2), '')) AS repaired_sha256
FROM all_ LEFT JOIN stat ON all_.conv_id IS NOT DISTINCT FROM stat.conv_id
     LEFT JOIN best ON all_.conv_id IS NOT DISTINCT FROM best.conv_id
""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by rule, its faults, and the cheapest repair of its structure."""
    return repair_report(damage(read(spark, sf_dir, "conversations")))
