"""Queries op1 to op13 over the driver tables, with their SQL where it exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm import (alignment, chat, decontaminate, embed_dedup, language_id, licenses, packing, quality,
                            prefix_trie, secret_scan, sharding, simhash, warc)
from hydrospark.llm.common import cut_lineage, drop_folder, held_out
from hydrospark.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



@_register("op1_language_id")
def op1(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, where=~held_out(F.col("doc_id")))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_WORDS = """
    regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

_ASSIGN_SQL = secret_scan.ASSIGN.replace("'", "''")


def _kind_sql(kind: str) -> str:
    pattern = secret_scan.PATTERNS[kind].replace("'", "''")
    group = 2 if kind == "assign" else 0
    least = secret_scan.ASSIGN_MIN if kind == "assign" else 1
    return f"""
  SELECT row_id, owner, doc_id, {secret_scan.KINDS.index(kind)} AS rank, '{kind}' AS kind,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + list_sum(list_transform(hits[1:i], lambda x: length(x))) - length(hits[i]) AS s, length(hits[i]) AS n, v[i] AS val
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT row_id, owner, doc_id, regexp_extract_all(txt, '{pattern}') AS hits,
                     regexp_extract_all(txt, '{pattern}', {group}) AS v, string_split_regex(txt, '{pattern}') AS gaps
              FROM d))
  WHERE length(v[i]) >= {least}"""


_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS txt
           FROM documents),
c AS ({' UNION ALL '.join(_kind_sql(k) for k in secret_scan.PATTERNS)}),
own AS (SELECT val, count(DISTINCT c.owner) AS n_owners, count(DISTINCT txt) AS n_repos
        FROM c JOIN d USING (row_id) GROUP BY val),
cls AS (SELECT c.*, CASE WHEN n_owners >= 3 AND n_repos >= 3 THEN 'copied'
                         WHEN regexp_matches(val, '[0-9]') AND len(list_distinct(string_split(val, ''))) >= 8
                         THEN 'live' END AS class FROM c JOIN own USING (val)),
sp AS (SELECT row_id, s, rank, s + n AS e, kind FROM cls
       UNION SELECT row_id, s + n - length(val), CASE class WHEN 'copied' THEN 3 ELSE 4 END, s + n, class FROM cls
       WHERE class IS NOT NULL),
g AS (SELECT row_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS every FROM sp GROUP BY row_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (row_id)
"""


@_register("op2_secret_scan", _OP2)
def op2(spark, sf_dir):
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"), by_text=True)
    counts = [F.size(F.filter("found", secret_scan.is_kind(k))).cast("long").alias(f"n_{k}")
              for k in secret_scan.PATTERNS]
    return found.select("doc_id", *counts,
                        F.sha2(secret_scan.span_text(F.col("found")), 256).alias("base_sha256"),
                        secret_scan.span_text(secret_scan.all_spans(F.col("found"), F.col("marks"))).alias("spans"))


@_register("op3_simhash")
def op3(spark, sf_dir):
    out = simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@_register("op4_license_scan")
def op4(spark, sf_dir):
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_OP5 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        replace(text, '\\', '\\\\'), '<\\|', '<_|', 'g'), '\\|>', '|_>', 'g'), '<s>', '<_s>', 'g'), '</s>', '<_/s>', 'g'),
        '\\[INST\\]', '[_INST]', 'g'), '\\[/INST\\]', '[_/INST]', 'g')) + length(role) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + count(*) * 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@_register("op5_chat_format", _OP5)
def op5(spark, sf_dir):
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(text).alias("text"))
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(table)
    turns, loss = chat.parse(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS.format(t='text')} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format(t='text')} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[s:s + 12], ' ') AS win, len(ws[s:s + 12]) AS n
      FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM w),
p AS (SELECT row_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)),
o AS (SELECT DISTINCT p.row_id, p.s, p.n, w.item_id FROM p JOIN w USING (win, n)),
h AS (SELECT row_id, count(DISTINCT k) AS n_hit
      FROM (SELECT row_id, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT row_id, s, n FROM o)) GROUP BY row_id),
i AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN i USING (row_id)
"""


@_register("op6_decontaminate", _OP6)
def op6(spark, sf_dir):
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      decontaminate.is_contaminated().alias("contaminated"))


_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS x FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY x, n) AS keep FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       translate(array_to_string([to_base(('0x' || x[i:i + 4])::BIGINT, 32, 4) FOR i IN range(1, 41, 5)], ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM k
"""


@_register("op7_warc", _OP7)
def op7(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    token = warc.write_archive(_table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path, token), with_payload=False)
    captures = cut_lineage(captures.drop("http", "requests", "metadatas"))
    drop_folder(spark, path)  # all that is wanted of the archive is read back
    return warc.originals(captures).select(
        F.col("metadata.page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("original.page_id").cast("long").alias("refers_to"))


@_register("op8_quality")
def op8(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), where=~held_out(F.col("doc_id")))
    out = quality.score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@_register("op9_packing")
def op9(spark, sf_dir):
    return packing.pack_texts(_table(spark, sf_dir, "documents"))


_OP10 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_dot_product(e, e) > 0),
l AS (SELECT a.r AS a, b.r AS b, a.vec_id AS ia, b.vec_id AS ib FROM ok a JOIN ok b ON a.r <> b.r
      AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT reach.a AS r, min(v.vec_id) AS c FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)
"""


@_register("op10_embedding_dedup", _OP10)
def op10(spark, sf_dir):
    return embed_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"))


def _crc32_sql(data: str) -> str:
    """Unsigned CRC-32 of a BLOB (polynomial 0xEDB88320, reflected), byte by byte;
    the query reads crc_table."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({data}), '..'), lambda b: ('0x' || b)::BIGINT)),
        lambda crc, b: xor(crc >> 8, tab[xor(crc & 255, b) + 1])))"""


_CRC_TABLE = """crc_bits AS (
  SELECT i, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_bits WHERE k = 8)"""


def _feistel_sql(x: str, bits: str, keys: list[int]) -> str:
    """A permuted position as nested selects, a level a round."""
    sql = f"SELECT {x} >> {bits} AS l, {x} & ((1::BIGINT << {bits}) - 1) AS r"
    for key in keys:
        sql = (f"SELECT r AS l, xor(l, xor(c, c >> 15) & ((1::BIGINT << {bits}) - 1)) AS r FROM (SELECT *, "
               f"(xor(b, b >> 15) * {0x45D9F3B}) & 2147483647 AS c FROM (SELECT *, "
               f"(xor(a, a >> 15) * {0x45D9F3B}) & 2147483647 AS b FROM (SELECT *, xor(r, {key}) AS a FROM ({sql}))))")
    return f"(SELECT (l << {bits}) | r FROM ({sql}))"


_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32_sql("encode(coalesce(text, ''))")} AS crc
      FROM documents, crc_table),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS rn FROM d),
n AS (SELECT n, (SELECT min(b) FROM range(1, 32) t(b) WHERE (1::BIGINT << (2 * b)::INT) >= n) AS h
      FROM (SELECT count(*) AS n FROM d)),
walk AS (SELECT rn, {_feistel_sql('rn', 'h', sharding.round_keys(0))} AS p FROM r, n
         UNION ALL SELECT rn, {_feistel_sql('p', 'h', sharding.round_keys(0))} FROM walk, n WHERE p >= n)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (p % 8)::INT AS shard, (p // 8)::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM r JOIN (SELECT rn, p FROM walk, n WHERE p < n) USING (rn)
"""


@_register("op11_sharding", _OP11)
def op11(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard_rows(docs, ["doc_id", "size", "text_crc32"], shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@_register("op12_alignment")
def op12(spark, sf_dir):
    out = alignment.align_corpus(_table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.col("groups").alias("groups_sha256"))


_OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, role, text
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {_crc32_sql("encode(conv_id::VARCHAR)")} % 4 AS h
      FROM t, crc_table GROUP BY conv_id, tab),
b AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.base),
s AS (SELECT b.conv_id, t.pos + 1 AS d, role, text FROM b JOIN t ON t.conv_id = b.base AND t.pos < taken
      UNION ALL SELECT b.conv_id, taken + t.pos - h + 1, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos >= h),
p AS (SELECT b.conv_id, coalesce(list((role, text) ORDER BY d) FILTER (d IS NOT NULL), []) AS turns
      FROM b LEFT JOIN s ON s.conv_id = b.conv_id GROUP BY b.conv_id),
m AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS pre
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM p)),
v AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends,
             CASE WHEN d > 0 THEN len(regexp_extract_all(pre[d][2], '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
      FROM m GROUP BY d, pre),
k AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (d, pre)),
a AS (SELECT e AS d, pre[1:e] AS pre, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(d + 1)) AS e FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves,
       a.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN a USING (d, pre) LEFT JOIN v u ON u.d = f.d - 1 AND u.pre = f.pre[1:f.d - 1]
"""


@_register("op13_prefix_trie", _OP13)
def op13(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))
