"""Queries that apply each operator of this subpackage to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix, mix_sql
from tidemark.llm.packing import pack
from tidemark.llm.pii import BASE, counted, listed, personal_data
from tidemark.llm.preference import neighbours, preference_pairs
from tidemark.llm.quality_classifier import quality_classifier
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.repair import damaged, repaired_conversations
from tidemark.llm.search import ranked
from tidemark.llm.substring import without_repeats
from tidemark.llm.token_counts import token_counts
from tidemark.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_bpe())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pack(table(spark, sf_dir, "documents"), byte_bpe())
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["begin"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return preference_pairs(turns, neighbours(turns)).withColumns({c: mask(c) for c in ("chosen_mask", "rejected_mask")})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("log_ratio", F.round("log_ratio", 6))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = personal_data(table(spark, sf_dir, "documents"))
    return done.select("doc_id", *(counted(k).alias(f"n_{k}") for k in BASE), F.sha2(listed(BASE), 256).alias("base_sha256"), listed().alias("spans"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repaired_conversations(turns, damaged(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_preference": op5_preference,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_personal_data": op11_personal_data,
    "op12_lexical_search": op12_lexical_search,
    "op13_structure_repair": op13_structure_repair,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_mixing": mix_sql(),
    "op5_preference": """
        WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
        p AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.n AS nc, b.n AS nr FROM n a JOIN n b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
        d AS (SELECT chosen_id, min(a.i) AS i FROM p JOIN t a ON a.conv_id = chosen_id LEFT JOIN t b ON b.conv_id = rejected_id AND b.i = a.i
              WHERE b.i IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY chosen_id),
        l AS (SELECT p.*, least(coalesce(d.i - 1, nc), nr) AS k FROM p LEFT JOIN d USING (chosen_id)),
        s AS (SELECT conv_id, i, role, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS h, replace(text, '<|', '< |') || '<|end|>' || chr(10) AS b FROM t),
        x AS (SELECT chosen_id, 'p' AS side, s.* FROM l JOIN s ON s.conv_id = chosen_id AND s.i <= k
              UNION ALL SELECT chosen_id, 'c', s.* FROM l JOIN s ON s.conv_id = chosen_id AND s.i > k
              UNION ALL SELECT chosen_id, 'r', s.* FROM l JOIN s ON s.conv_id = rejected_id AND s.i > k),
        y AS (SELECT *, coalesce(sum(length(h) + length(b)) OVER (PARTITION BY chosen_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM x),
        z AS (SELECT chosen_id, side, string_agg(h || b, '' ORDER BY i) AS v,
                     string_agg(CASE WHEN role = 'assistant' THEN CAST(o + length(h) AS BIGINT) || '-' || CAST(o + length(h) + length(b) AS BIGINT) END, ',' ORDER BY i) AS m FROM y GROUP BY ALL)
        SELECT l.chosen_id, rejected_id, CAST(k AS BIGINT) AS n_common, coalesce(zp.v, '') AS prompt, coalesce(zc.v, '') AS chosen, coalesce(zr.v, '') AS rejected,
               coalesce(zc.m, '') AS chosen_mask, coalesce(zr.m, '') AS rejected_mask
        FROM l LEFT JOIN z zp ON zp.chosen_id = l.chosen_id AND zp.side = 'p' LEFT JOIN z zc ON zc.chosen_id = l.chosen_id AND zc.side = 'c'
        LEFT JOIN z zr ON zr.chosen_id = l.chosen_id AND zr.side = 'r'""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS s FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((('0x' || substr(s, CAST(1 + 5 * (i // 4) AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op7_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m WHERE len(w) >= 5)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT i + o.range) AS n FROM r, range(5) o GROUP BY doc_id),
        x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
        f AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * word_chars)::INT
                     + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 7 * n_lines)::INT + 16 * (n_words > 0 AND word_chars > 40 * n_words)::INT
                     + 32 * (n_words > 1000000)::INT AS BIGINT) AS failed FROM x)
        SELECT *, (failed & 3) > 0 AS base_failed, (failed & 31) = 0 AS kept FROM f""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
        r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
        c AS (SELECT doc_id, list(DISTINCT i + o.range) AS gone FROM r, range(35) o GROUP BY doc_id),
        g AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
        u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        x AS (SELECT doc_id, unnest(gone) AS i FROM c),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM g LEFT JOIN k USING (doc_id)""",
    "op11_personal_data": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
        k(kind, o, p) AS (VALUES ('email', 1, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)'), ('ip', 2, '([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)'), ('card', 3, '([0-9](?:[ -]?[0-9])+)'), ('phone', 4, '(\+[0-9][ ().0-9-]+[0-9])'),
            ('iban', 5, '\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b'), ('ssn', 6, '\b([0-9]{3}-[0-9]{2}-[0-9]{4})\b')),
        m AS (SELECT row, t, 'email' AS kind, regexp_replace(t, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', chr(57344) || '\1' || chr(57345), 'g') AS x FROM d WHERE contains(t, '@')
              UNION ALL SELECT row, t, 'ip', regexp_replace(t, '([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)', chr(57344) || '\1' || chr(57345), 'g') FROM d
              UNION ALL SELECT row, t, 'card', regexp_replace(t, '([0-9](?:[ -]?[0-9])+)', chr(57344) || '\1' || chr(57345), 'g') FROM d
              UNION ALL SELECT row, t, 'phone', regexp_replace(t, '(\+[0-9][ ().0-9-]+[0-9])', chr(57344) || '\1' || chr(57345), 'g') FROM d WHERE contains(t, '+')
              UNION ALL SELECT row, t, 'iban', regexp_replace(t, '\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b', chr(57344) || '\1' || chr(57345), 'g') FROM d
              UNION ALL SELECT row, t, 'ssn', regexp_replace(t, '\b([0-9]{3}-[0-9]{2}-[0-9]{4})\b', chr(57344) || '\1' || chr(57345), 'g') FROM d),
        u AS (SELECT row, t, kind, unnest(string_split(x, chr(57344))) AS part, generate_subscripts(string_split(x, chr(57344)), 1) AS i FROM m WHERE contains(x, chr(57344))),
        s AS (SELECT row, t, kind, i, split_part(part, chr(57345), 1) AS v,
                     coalesce(sum(length(replace(part, chr(57345), ''))) OVER (PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM u),
        v AS (SELECT row, kind, b, b + length(v) AS e, v, regexp_replace(v, '[^0-9]', '', 'g') AS g, replace(v, ' ', '') AS c,
                     lower(substr(t, greatest(b - 48, 0) + 1, least(b, 48)) || chr(10) || substr(t, b + length(v) + 1, 24)) AS w FROM s WHERE i > 1),
        f AS (SELECT row, b, e, k.kind, o FROM v JOIN k ON v.kind = k.kind WHERE CASE v.kind WHEN 'email' THEN true
              WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS BIGINT), 256) > 255)) = 0
              WHEN 'card' THEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(g)), lambda j: CASE WHEN j % 2 = 0 THEN substr(g, CAST(length(g) - j AS INT), 1)::INT ELSE (2 * substr(g, CAST(length(g) - j AS INT), 1)::INT) // 10 + (2 * substr(g, CAST(length(g) - j AS INT), 1)::INT) % 10 END)) % 10 = 0
              WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
              WHEN 'iban' THEN list_reduce(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)::BIGINT), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
              ELSE g[1:3] NOT IN ('000', '666') AND g[1:3] < '900' AND g[4:5] <> '00' AND g[6:9] <> '0000' AND regexp_matches(w, '(?:^|[^a-z0-9])(?:ssn|social security)(?:$|[^a-z0-9])')
                   AND NOT regexp_matches(w, '(?:^|[^a-z0-9])(?:part|item|serial)(?:$|[^a-z0-9])') END),
        a AS (SELECT row, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
                     string_agg(kind || ':' || b || ':' || e, ',' ORDER BY o, b) FILTER (o < 5) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY o, b) AS spans FROM f GROUP BY row)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)""",
    "op12_lexical_search": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
        a AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
        t AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, a GROUP BY term, N),
        m AS (SELECT row, doc_id, 100 - 90 + (90 * len(w)::BIGINT * N) // L AS m FROM d, a WHERE len(w) > 0),
        s AS (SELECT item, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
              FROM (SELECT DISTINCT item, unnest(w) AS term FROM q) JOIN t USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY ALL),
        r AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (row) WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN q USING (item) WHERE rank <= 10""",
    "op13_structure_repair": r"""
        WITH RECURSIVE k AS (SELECT list(v ORDER BY n) AS k FROM (SELECT n, list_reduce(range(8)::BIGINT[], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS v FROM (SELECT unnest(range(256)) AS n))),
        c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
        c1 AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(s, ''), lambda y: ascii(y)::BIGINT), lambda a, y: xor(a >> 8, k[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) % 20 AS f FROM c0, k),
        c2 AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c1 WHERE f <> 0),
        c3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c2),
        c4 AS (SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS mark, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, left(role, 1) AS r,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM c3),
        c AS (SELECT *, CASE WHEN mark = '' THEN 1 WHEN seen > 1 THEN 2 WHEN mark NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM c4),
        e(q, code, cost, goal) AS (SELECT q, repeat('I', k::INT), 3 * k, CASE WHEN k = 0 THEN q WHEN (q = 'u') = (k = 1) THEN 'a' ELSE 'u' END FROM (SELECT unnest(['-', 's', 'u', 'a']) AS q), (SELECT unnest(range(3)) AS k)),
        d AS (SELECT conv_id, 0::BIGINT AS i, '-' AS q, 0::BIGINT AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM c)
              UNION ALL
              SELECT conv_id, i, z.q, z.cost, z.audit, z.said FROM (
                SELECT conv_id, i, q2, arg_min({'q': q2, 'cost': cost, 'audit': audit, 'said': said}, {'cost': cost, 'audit': audit}) AS z FROM (
                  SELECT c.conv_id, c.i, t.q2, d.cost + e.cost + t.cost + CASE WHEN f = 3 AND t.edit <> 'D' THEN 3 ELSE 0 END AS cost, d.audit || e.code || t.edit AS audit,
                         d.said || CASE length(e.code) WHEN 0 THEN '' WHEN 1 THEN chr(10) || CASE e.goal WHEN 'u' THEN 'user:' ELSE 'assistant:' END
                           ELSE chr(10) || CASE e.goal WHEN 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END END
                           || CASE t.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || c.role || ':' || c.text ELSE chr(10) || CASE t.q2 WHEN 'u' THEN 'user:' ELSE 'assistant:' END || c.text END AS said
                  FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.i = d.i + 1 JOIN e ON e.q = d.q
                  JOIN (VALUES ('-', 'D', '-', 4, ''), ('s', 'D', 's', 4, ''), ('u', 'D', 'u', 4, ''), ('a', 'D', 'a', 4, ''), ('-', 'K', 's', 0, 's'), ('-', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('a', 'K', 'u', 0, 'u'), ('u', 'K', 'a', 0, 'a'),
                        ('-', 'R', 'u', 3, ''), ('s', 'R', 'u', 3, ''), ('a', 'R', 'u', 3, ''), ('u', 'R', 'a', 3, '')) t(q, edit, q2, cost, r)
                    ON t.q = e.goal AND (t.edit <> 'K' OR t.r = c.r) AND (t.edit = 'D' OR c.f NOT IN (1, 2))) GROUP BY conv_id, i, q2)),
        w AS (SELECT conv_id, arg_min({'cost': cost, 'audit': audit, 'said': said}, {'cost': cost, 'audit': audit}) AS z FROM (
              SELECT d.conv_id, d.cost + e.cost AS cost, d.audit || e.code AS audit, d.said || CASE length(e.code) WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END AS said
              FROM d JOIN (SELECT conv_id, max(i) AS n FROM c GROUP BY conv_id) x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = x.n JOIN e ON e.q = d.q WHERE e.goal = 'a' OR (d.q = '-' AND e.code = '')) GROUP BY conv_id),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
                     count(*) FILTER (i > 1 AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(z.cost, 0)::BIGINT AS cost, coalesce(z.audit, '') AS audit, sha256(coalesce(substr(z.said, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
