"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (ann, bpe, convrepair, exactdedup, htmltext, kmeans, langid, linededup, mixing, ngramjoin, suffixdedup,
                            tokenfiles, warc)
from corpusloom.sources.tables import load_table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC files and read the archives back."""
    return (warc.archive_pages(load_table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents``."""
    return bpe.encode_digests(load_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one of ``embeddings``."""
    return ann.nearest(load_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` that repeat another line but for one edit."""
    return linededup.report(load_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``."""
    return langid.identify(load_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach Jaccard 0.9."""
    return ngramjoin.jaccard_components(load_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return htmltext.extract(load_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots and positions of all ``documents`` in the mix of their sources."""
    return mixing.mix_order(load_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of ``documents`` and read them back."""
    manifest = tokenfiles.token_files(load_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return tokenfiles.read_digests(manifest)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in ``documents``."""
    return exactdedup.exact_groups(load_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` in strings of 200 bytes that occur again anywhere."""
    return suffixdedup.remove_repeats(load_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every repaired conversation."""
    return convrepair.digests(convrepair.repair(convrepair.damaged(load_table(spark, sf_dir, "conversations"))))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of eight integer centroids over ``embeddings``."""
    return kmeans.cluster(load_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_bpe, op3_nearest, op4_line_dedup, op5_language, op6_ngram_join, op7_mixing,
                                   op8_token_files, op9_html_text, op10_exact_dedup, op11_suffix_dedup,
                                   op12_repair, op13_clusters)}

def _clusters_sql(rounds: int = 10) -> str:
    """SQL of ``op13_clusters``, one pair of expressions a round."""
    text = """
        WITH v AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
          WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
        m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q AS m FROM v
          WHERE vec_id IS NOT NULL QUALIFY c < 8)"""
    for r in range(rounds + 1):
        text += f""",
        a{r} AS MATERIALIZED (SELECT rid, vec_id, q, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
          SELECT rid, vec_id, q, c, list_sum([(q[i] - m[i]) * (q[i] - m[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v, m{r})
          GROUP BY rid, vec_id, q)"""
        if r < rounds:
            text += f""",
        m{r + 1} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM m{r} LEFT JOIN (
          SELECT c, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS n FROM (
            SELECT c, i, sum(q[i]) AS s, count(*) AS k FROM a{r}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c) USING (c))"""
    return text + f"""
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
          (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN m{rounds} USING (c)"""


ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS hx, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
        SELECT page_id, payload_bytes,
          array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(hx, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)
            for i in range(32)], '') AS payload_digest,
          CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
    "op4_line_dedup": """
        WITH RECURSIVE occ AS (
          SELECT doc_id, pos - 1 AS pos, trim(raw) AS line FROM (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) WHERE trim(raw) <> ''),
        ln AS (SELECT DISTINCT line, length(line) AS n FROM occ WHERE length(line) >= 32),
        cand AS (
          SELECT x.line AS a, y.line AS b, x.n AS n, y.n AS m FROM ln x JOIN ln y
            ON x.n = y.n AND left(x.line, x.n // 2) = left(y.line, x.n // 2) AND x.line < y.line
          UNION SELECT x.line, y.line, x.n, y.n FROM ln x JOIN ln y
            ON x.n = y.n AND right(x.line, x.n - x.n // 2) = right(y.line, x.n - x.n // 2) AND x.line < y.line
          UNION SELECT x.line, y.line, x.n, y.n FROM ln x JOIN ln y
            ON x.n = y.n - 1 AND left(x.line, x.n // 2) = left(y.line, x.n // 2)
          UNION SELECT x.line, y.line, x.n, y.n FROM ln x JOIN ln y
            ON x.n = y.n - 1 AND right(x.line, x.n - x.n // 2) = right(y.line, x.n - x.n // 2)),
        link AS (SELECT a, b FROM cand WHERE len([p for p in range(m) if
            left(a, p) = left(b, p) AND substr(a, p + 1 + n - m + 1) = substr(b, p + 2)]) > 0),
        both_ AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
        reach(u, v) AS (SELECT u, u FROM both_ UNION SELECT r.u, e.v FROM reach r JOIN both_ e ON r.v = e.u),
        class_ AS (SELECT u AS line, min(v) AS class_line FROM reach GROUP BY u),
        f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY coalesce(class_line, line) ORDER BY doc_id, pos) AS k
              FROM occ LEFT JOIN class_ USING (line)),
        g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_removed,
                string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (k > 1) AS removed FROM f GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
        FROM documents d LEFT JOIN g USING (doc_id)""",
    "op6_ngram_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM (
          SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]
            WHEN len(ws) > 0 THEN ['=' || array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM sh a JOIN sh b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
        edge AS MATERIALIZED (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
        reach(u, v) AS (SELECT u, u FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
        comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.u = d.doc_id""",
    "op7_mixing": """
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key FROM documents),
        sz AS (SELECT key, sqrt(count(*)::DOUBLE) AS w FROM d GROUP BY key),
        sh AS (SELECT key, 1000 * w / sum(w) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x FROM sz),
        lo AS (SELECT key, floor(x)::INT AS c, round(x - floor(x), 9) AS rest FROM sh),
        tg AS (SELECT key, c + (row_number() OVER (ORDER BY rest DESC, key) <= 1000 - sum(c) OVER ())::INT AS c FROM lo),
        ar AS (SELECT list(c ORDER BY key) AS cs, list(key ORDER BY key) AS ks FROM tg),
        edf(t, done, pick) AS (
          SELECT -1, [0 for c in cs], 0::BIGINT FROM ar
          UNION ALL
          SELECT t + 1, [n + (i = pk)::INT for n, i in done], pk FROM (
            SELECT t, done, list_min([CASE WHEN done[i] < c AND done[i] * 1000 // c <= t + 1
              THEN ((done[i] + 1) * 1000 + c - 1) // c * 1000000 + i END for c, i in cs]) % 1000000 AS pk
            FROM edf, ar WHERE t < 999)),
        cy AS (SELECT ks[pick] AS key, cs[pick] AS c, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j
               FROM edf, ar WHERE t >= 0),
        rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS r FROM d),
        bl AS (SELECT rk.*, r // 16 AS block, (r // 16) // tg.c AS turn, (r // 16) % tg.c AS j FROM rk JOIN tg USING (key)),
        pl AS (SELECT doc_id, source, r, block, turn * 1000 + slot AS slot, turn * 1000 + j * 1000 // c AS release,
                 turn * 1000 + ((j + 1) * 1000 + c - 1) // c AS deadline FROM bl JOIN cy USING (key, j))
        SELECT doc_id, source, block, slot, release, deadline, row_number() OVER (ORDER BY slot, r) - 1 AS position FROM pl""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op11_suffix_dedup": """
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT rid, s, b[s + 1:s + 200] AS t FROM (SELECT rid, b, unnest(range(octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200)),
        twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY t) AS n FROM w) WHERE n > 1),
        edge AS (SELECT *, s > lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 IS NOT FALSE AS fresh FROM twice),
        isle AS (SELECT rid, s, sum((coalesce(fresh, true))::INT) OVER (PARTITION BY rid ORDER BY s) AS k FROM edge),
        span AS (SELECT rid, k, min(s) AS a, max(s) + 200 AS z FROM isle GROUP BY rid, k),
        per AS (SELECT rid, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list([a, z] ORDER BY a) AS sp FROM span GROUP BY rid)
        SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
          sha256(CASE WHEN sp IS NULL THEN b ELSE list_reduce([b[(CASE WHEN i = 0 THEN 0 ELSE sp[i][2] END) + 1:
             CASE WHEN i = len(sp) THEN octet_length(b) ELSE sp[i + 1][1] END] FOR i IN range(len(sp) + 1)], lambda x, y: x || y) END) AS kept_sha256
        FROM d LEFT JOIN per USING (rid)""",
    "op12_repair": """
        WITH RECURSIVE
        bits(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
          SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
        crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
        src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        hit AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([ascii(x) FOR x IN string_split(key, '')],
          lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM src, crc),
        rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
        bare AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM rows_),
        item AS (SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN right(t, 1) IN ('.', '!', '?') THEN 'k' ELSE 't' END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM bare),
        told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
            count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM item GROUP BY conv_id),
        step(st, role, nx) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        put(st, role, nx) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
        edit(e) AS (VALUES ('K'), ('R'), ('D')),
        way(conv_id, i, st, cost, audit, rep) AS (
          SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM told
          UNION ALL
          SELECT conv_id, i, st, cost, audit, rep FROM (
            SELECT w.conv_id, w.i + 1 AS i,
              CASE e WHEN 'D' THEN w.st WHEN 'K' THEN s.nx ELSE p.nx END AS st,
              w.cost + CASE e WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e <> 'D' AND fault = 't' THEN 3 ELSE 0 END AS cost,
              w.audit || e AS audit,
              CASE e WHEN 'D' THEN w.rep WHEN 'K' THEN list_append(w.rep, x.role || ':' || x.text)
                ELSE list_append(w.rep, p.role || ':' || x.text) END AS rep
            FROM (SELECT conv_id, i, st, cost, audit, rep FROM way
                  UNION ALL SELECT conv_id, i, nx, cost + 3, audit || 'I', list_append(rep, role || ':') FROM way JOIN put USING (st)) w
            JOIN item x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = w.i + 1
            JOIN put p ON p.st = w.st
            CROSS JOIN edit
            LEFT JOIN step s ON s.st = w.st AND s.role = left(x.role, 1)
            WHERE e = 'D' OR (fault IN ('k', 't') AND (e = 'R' OR s.nx IS NOT NULL)))
          QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
        fin AS (SELECT conv_id, cost, audit, rep FROM (
            SELECT w.* FROM way w JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.n
            UNION ALL SELECT conv_id, i, nx, cost + 3, audit || 'I', list_append(rep, role || ':') FROM (
              SELECT w.* FROM way w JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.n) JOIN put USING (st))
          WHERE st IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
          coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
          sha256(coalesce(array_to_string(rep, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN told t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN fin f ON c.conv_id IS NOT DISTINCT FROM f.conv_id""",
    "op13_clusters": _clusters_sql(),
}
