"""The registered queries of this package: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdrank.llm import (
    bpe, fill_middle, fingerprints, hamming_search, language_id, near_dedup, packing, quality, repair, sharding,
    tool_calls, toxicity, url_filter,
)
from crowdrank.llm.common import fold_of, read_table

PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: The rules of the URL query, as given: fixed values.
URL_RULES = [
    url_filter.host_path_rule("net/", "block"),
    url_filter.host_path_rule("example.net/en/", "allow"),
    url_filter.host_path_rule("example.com/de/", "block"),
    url_filter.host_path_rule("org/fr/", "allow"),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, usable=fold_of(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "quality_score.text_score", "quality_score.meta_score", "quality_score.score",
        (F.col("quality_score.score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), PACKING_TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, usable=fold_of(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return hamming_search.search(vectors, vectors.where("vec_id % 100 = 0"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    calls, results = tool_calls.conversation_calls(conversations)
    schemas = spark.createDataFrame(
        tool_calls.CONVERSATION_SCHEMAS, "name string, field string, type string, required boolean"
    )
    linked = tool_calls.link_tool_calls(calls, results, schemas)
    return linked.unionByName(tool_calls.conversation_messages(conversations)).select(
        F.col("group_id").alias("conv_id"), F.col("seq").alias("turn"), "call_id", "kind", "level", "status",
        F.array_join("errors", "; ").alias("errors"), "json",
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(
        read_table(spark, sf_dir, "pages"), [*URL_RULES, *url_filter.WORD_RULES]
    )
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, shingle=2, percent=80)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    profiles = language_id.collect_profiles(language_id.train_profiles(docs.where(~held_out)))
    judged = language_id.identify(docs.select("doc_id", "text"), profiles, result_col="found")
    return judged.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint_text(F.col("anchors")).alias("fingerprint"),
        fingerprints.fingerprint_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        fingerprints.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_corpus(
        read_table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN
    )
    decoded = bpe.decode_ids(encoded, BPE_RANKS)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


NOTHING_SHA256 = hashlib.sha256(b"").hexdigest()


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    summary, turns = repair.repair_conversations(repair.damage(conversations))
    hashes = repair.conversation_hashes(turns)
    # The ids come from the undamaged table: a conversation may have lost all its rows.
    ids = conversations.select("conv_id").distinct().withColumn("id", F.col("conv_id").cast("string"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        ids.join(summary, F.col("id").eqNullSafe(F.col("conv")), "left").drop("conv")
        .join(hashes, F.col("id").eqNullSafe(F.col("conv")), "left")
        .select(
            "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.lit(NOTHING_SHA256)).alias("repaired_sha256"),
        )
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = fill_middle.fill_in_middle(docs)
    return done.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.col("fim.sha256").alias("output_sha256"),
        fill_middle.restored_sha256(F.col("fim.output"), F.col("fim.form")).alias("restored_sha256"),
    )


SHARDS = 16


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    assigned = sharding.assign_shards(docs, dict.fromkeys(range(SHARDS), 1.0), dict.fromkeys(range(SHARDS + 1), 1.0))
    numbered = sharding.number_rows(assigned)
    return numbered.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        "grown_shard",
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_hamming_search": op4_hamming_search,
    "op5_tool_calls": op5_tool_calls,
    "op6_url_filter": op6_url_filter,
    "op7_near_dedup": op7_near_dedup,
    "op8_language": op8_language,
    "op9_fingerprints": op9_fingerprints,
    "op10_bpe": op10_bpe,
    "op11_repair": op11_repair,
    "op12_fill_middle": op12_fill_middle,
    "op13_sharding": op13_sharding,
}



def _crc_step(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes."""
    steps = ", ".join(str(_crc_step(byte)) for byte in range(256))
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (
        f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
        f"lambda c, b: xor(c // 256, ([{steps}]::BIGINT[])[(xor(c, b) & 255) + 1])))"
    )


#: DuckDB SQL for the queries that SQL can express exactly.
ORACLE: dict[str, str] = {
    "op4_hamming_search": r"""
        WITH codes AS (
            SELECT vec_id, [embedding[j]::DOUBLE > 0 FOR j IN range(1, 65)] AS code FROM embeddings
        ), apart AS (
            SELECT q.vec_id AS query_id, x.vec_id,
                   list_sum([(q.code[j] <> x.code[j])::INT FOR j IN range(1, 65)])::INT AS distance
            FROM codes q JOIN codes x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id
        )
        SELECT query_id, rank, vec_id, distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM apart
        ) WHERE rank <= 10
    """,
    "op5_tool_calls": r"""
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text, length(text) % 23 AS spoilt,
                   CASE WHEN turn < 2 THEN []
                        WHEN opened < turn AND opened <> turn - 2
                        THEN [conv_id || ':' || (turn - 2), conv_id || ':' || opened]
                        ELSE [conv_id || ':' || (turn - 2)] END AS after
            FROM (SELECT *, turn - (turn - turn % 2) % 8 AS opened FROM conversations WHERE role = 'user')
        ), needs AS (
            SELECT call_id, unnest(after) AS up FROM calls
        ), paths AS (
            SELECT call_id, 0 AS d, false AS missing FROM calls
            UNION
            SELECT call_id, 0, true FROM needs WHERE up NOT IN (SELECT call_id FROM calls)
            UNION
            SELECT n.call_id, p.d + 1, p.missing FROM needs n JOIN paths p ON n.up = p.call_id
        ), depth AS (
            SELECT call_id, max(d) AS d, bool_or(missing) AS missing FROM paths GROUP BY call_id
        ), results AS (
            SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text
            FROM conversations WHERE role = 'assistant'
        )
        SELECT c.conv_id, c.turn, c.call_id, 'call' AS kind, (2 * d.d)::BIGINT AS level,
               CASE WHEN d.missing THEN 'missing'
                    WHEN EXISTS (SELECT 1 FROM results r WHERE r.call_id = c.call_id) THEN 'ok'
                    ELSE 'unanswered' END AS status,
               CASE spoilt WHEN 0 THEN 'not json' WHEN 1 THEN 'wrong type chars' WHEN 2 THEN 'missing text'
                    WHEN 3 THEN 'unknown note' ELSE '' END AS errors,
               '{"arguments":' || CASE WHEN spoilt = 0 THEN 'null' ELSE
                   '{' || CASE WHEN turn < 2 THEN '' ELSE '"after":' || to_json(c.after)::VARCHAR || ',' END
                   || '"chars":' || CASE WHEN spoilt = 1 THEN '"' || length(c.text) || '"' ELSE length(c.text)::VARCHAR END
                   || CASE WHEN spoilt = 3 THEN ',"note":"spare"' ELSE '' END
                   || CASE WHEN spoilt = 2 THEN '' ELSE ',"text":' || to_json(c.text) END
                   || ',"turn":' || c.turn || '}' END || ',"id":"' || c.call_id || '","name":"'
               || CASE WHEN c.turn >= 2 THEN 'follow' ELSE 'open' END || '","type":"call"}' AS json
        FROM calls c JOIN depth d USING (call_id)
        UNION ALL
        SELECT r.conv_id, r.turn, r.call_id, 'result', (2 * d.d + 1)::BIGINT,
               CASE WHEN d.call_id IS NULL THEN 'orphan' ELSE 'ok' END, '',
               '{"content":' || to_json(r.text) || ',"id":"' || r.call_id || '","type":"result"}'
        FROM results r LEFT JOIN depth d USING (call_id)
        UNION ALL
        SELECT conv_id, turn, NULL, 'message', NULL, 'ok', '',
               '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":'
               || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}'
        FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
    """,
    "op6_url_filter": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0
                   THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
        ), cut AS (
            SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest
        ), parts AS (
            SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut
        ), rules(rhost, rpath, rverdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                   ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), fits AS (
            SELECT DISTINCT host, path, rhost || rpath AS rule, rverdict,
                   row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC) AS k
            FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
              ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT page_id, p.host, p.path, f.rule,
               CASE WHEN f.rule IS NOT NULL THEN f.rverdict
                    WHEN regexp_matches(lower(p.host || p.path),
                         '(^|[^a-z0-9])(login|signin|cart|checkout|adserver|doubleclick)([^a-z0-9]|$)')
                    THEN 'block' ELSE 'allow' END AS verdict
        FROM parts p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON f.host = p.host AND f.path = p.path
    """,
    "op11_repair": rf"""
        WITH RECURSIVE named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw
            FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
                   CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM named
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
            FROM damaged
        ), seen AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS times,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed
        ), judged AS (
            SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, before,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN times > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
            FROM seen
        ), inserted(state, made, edits, cost, lines, now) AS (
            -- states: e nothing yet, s, u, a; at most two inserts at one place
            SELECT s, 0, '', 0, ''::VARCHAR, s FROM (VALUES ('e'), ('s'), ('u'), ('a')) t(s)
            UNION ALL
            SELECT state, made + 1, edits || 'I', cost + 3,
                   lines || CASE now WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10),
                   CASE now WHEN 'u' THEN 'a' ELSE 'u' END
            FROM inserted WHERE made < 2
        ), walk(conv_id, i, state, cost, audit, lines) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, 'e', 0, '', '' FROM damaged
            UNION ALL
            SELECT conv_id, i, state, best.cost, best.audit, best.lines FROM (
                SELECT conv_id, i, state, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
                    SELECT w.conv_id, j.i, w.state, w.cost + 4 AS cost, w.audit || 'D' AS audit, w.lines
                    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
                    UNION ALL
                    SELECT w.conv_id, j.i, j.initial,
                           w.cost + n.cost + CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END,
                           w.audit || n.edits || 'K', w.lines || n.lines || j.role || ':' || j.text || chr(10)
                    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
                    JOIN inserted n ON n.state = w.state
                    WHERE coalesce(j.fault, '') NOT IN ('blank', 'duplicate')
                      AND n.now || j.initial IN ('es', 'eu', 'su', 'ua', 'au')
                    UNION ALL
                    SELECT w.conv_id, j.i, CASE n.now WHEN 'u' THEN 'a' ELSE 'u' END,
                           w.cost + n.cost + 3 + CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END,
                           w.audit || n.edits || 'R',
                           w.lines || n.lines || CASE n.now WHEN 'u' THEN 'assistant:' ELSE 'user:' END || j.text || chr(10)
                    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
                    JOIN inserted n ON n.state = w.state
                    WHERE coalesce(j.fault, '') NOT IN ('blank', 'duplicate')
                ) GROUP BY conv_id, i, state
            )
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                   max(i) AS n
            FROM judged GROUP BY conv_id
        ), ended AS (
            SELECT c.conv_id, min({{'cost': w.cost + n.cost, 'audit': w.audit || n.edits, 'lines': w.lines || n.lines}}) AS best
            FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
            JOIN inserted n ON n.state = w.state AND n.now IN ('e', 'a') GROUP BY c.conv_id
        )
        SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank,
               coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
               coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
               coalesce(e.best.audit, '') AS audit,
               sha256(coalesce(left(e.best.lines, greatest(length(e.best.lines) - 1, 0)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op12_fill_middle": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents
        ), numbered AS (
            SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                          OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), cut AS (
            SELECT doc_id, text, n, form, least(c1, c2) AS a, abs(c1 - c2) AS m,
                   substr(text, 1, least(c1, c2)) AS prefix, substr(text, least(c1, c2) + 1, abs(c1 - c2)) AS middle,
                   substr(text, greatest(c1, c2) + 1) AS suffix
            FROM numbered
        ), made AS (
            SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
            FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN m END AS middle_chars, sha256(output) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN output
                      WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || split_part(output, '<M>', 2)
                           || split_part(split_part(output, '<S>', 2), '<M>', 1)
                      ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2)
                           || substr(output, 4, strpos(output, '<P>') - 4) END) AS restored_sha256
        FROM made
    """,
    "op13_sharding": rf"""
        WITH bids AS (
            SELECT key, s AS shard, -ln((('0x' || substr(md5(key || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE)
                                       / 4503599627370496::DOUBLE) AS bid
            FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, chr(0)) AS key FROM documents), range({SHARDS + 1}) t(s)
        ), chosen AS (
            SELECT key, min({{'bid': bid, 'shard': shard}}) FILTER (shard < {SHARDS}) AS kept,
                   min({{'bid': bid, 'shard': shard}}) AS grown
            FROM bids GROUP BY key
        ), sized AS (
            SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
                   {crc32_sql("coalesce(text, '')")} AS text_crc32, kept.shard::INT AS shard, grown.shard::INT AS grown_shard
            FROM documents JOIN chosen ON key = coalesce(doc_id::VARCHAR, chr(0))
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
        FROM sized
    """,
}
