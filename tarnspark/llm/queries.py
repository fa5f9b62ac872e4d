"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, token_files, trie, warc
from .byte_bpe import round_trip_documents
from .chat import render_chats
from .common import table
from .importance import draw, importance
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality import BOILERPLATE, judge_documents
from .substring_dedup import dedup_substrings
from .topk import top_k


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_repeat=4.0, seed=17)
    return uses.select(F.col("id").alias("doc_id"), "source", "copies", "n_tokens", "epoch", "block", "place")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("original.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = round_trip_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return out.select("original.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), window=35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return out.select("original.doc_id", *[f"verdict.{x}" for x in names], F.sha2("verdict.clean_text", 256).alias("clean_sha256"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(table(spark, sf_dir, "conversations"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda names: F.filter("spans", lambda s: s["kind"].isin(*names))
    base = [k.name for k in pii.KINDS[: pii.BASE]]
    joined = lambda spans, *more: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[x].cast("string") for x in ("kind", "start", "end", *more)])), ",")
    counts = [F.size(of([k.name])).cast("long").alias(f"n_{k.name}") for k in pii.KINDS]
    return out.select("original.doc_id", *counts, F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), joined(F.col("spans"), "score").alias("scores"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = draw(importance(docs, target, seed=42, keep=["doc_id"]), percent=5)
    return out.select("original.doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = trie.with_shared_heads(*trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(trie.saved(turns, "trie-rebuilt"), convs)


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_minhash": op5_minhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_token_files": op8_token_files,
    "op9_block_topk": op9_block_topk,
    "op10_chat_snapshots": op10_chat_snapshots,
    "op11_pii": op11_pii,
    "op12_importance": op12_importance,
    "op13_prefix_trie": op13_prefix_trie,
}


def _sql_spans(number: int, pattern: str, valid: str) -> str:
    """Spans of a pattern's matches m for which valid holds: row_id, kind, start_at, end_at."""
    return f"""SELECT row_id, {number} AS kind, start_at, start_at + size AS end_at FROM (
    SELECT row_id, m, size, (coalesce(list_sum(list_transform(parts[:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[:i], lambda x: length(x))), 0))::BIGINT AS start_at FROM (
      SELECT row_id, parts, ms, i, m, {"length(m)" if number != 4 else _SQL_IBAN_SIZE} AS size FROM (
        SELECT row_id, parts, ms, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (
          SELECT row_id, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS ms FROM d)))
    WHERE {valid})"""


#: The length at which an IBAN of its country's length ends in m, null if m has fewer characters.
_SQL_IBAN_SIZE = "list_filter(range(1, length(m) + 1), lambda e: length(replace(m[:e], ' ', '')) = MAP {" + ", ".join(f"'{k}': {n}" for k, n in pii.IBAN_LENGTHS.items()) + "}[m[:2]])[1]"
_SQL_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SQL_LUHN = f"list_sum(list_transform(string_split(reverse({_SQL_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0"
_SQL_MOD_97 = """list_reduce(list_concat([0], list_transform(string_split(replace(m[5:size], ' ', '') || m[:4], ''), lambda x: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)),
      lambda a, v: (CASE WHEN v > 9 THEN 100 * a ELSE 10 * a END + v) % 97) = 1"""
_SQL_PERSONAL = " UNION ALL ".join(
    _sql_spans(*x)
    for x in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        (1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
        (2, r"[0-9](?:[\x20-]?[0-9])+", f"length({_SQL_DIGITS}) BETWEEN 16 AND 19 AND {_SQL_LUHN}"),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_SQL_DIGITS}) BETWEEN 8 AND 15"),
        (4, r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", f"size IS NOT NULL AND m[size + 1] IN ('', ' ') AND {_SQL_MOD_97}"),
        (5, r"[0-9](?:[\x20-]?[0-9])+", f"length({_SQL_DIGITS}) BETWEEN 12 AND 15 AND {_SQL_LUHN}"),
        (6, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "m[:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'"),
        (7, r"\b0[0-9](?:[ ./-]?[0-9]){6,11}\b", "true"),
    )
)
_SQL_CONTEXT = " ".join(f"WHEN {i} THEN '\\b(?:{'|'.join(k.context)})'" for i, k in enumerate(pii.KINDS))
#: CRC-32 of a list of bytes b, by a table of 256 steps made by its rule.
_SQL_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS steps"
_SQL_CRC = "xor(list_reduce(list_concat([4294967295], b), lambda x, y: xor(steps[(xor(x, y) & 255) + 1], x >> 8)), 4294967295)"

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, row_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l
), k AS (
  SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY row_id""",
    "op4_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT row_id, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d
), f AS (
  SELECT row_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM w WHERE i + 34 <= len(ws)
), r AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY h) > 1 AS again FROM f
), c AS (
  SELECT w.row_id, w.i, w.ws[w.i] AS word, coalesce(max(again::INT) OVER (PARTITION BY w.row_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN r ON r.row_id = w.row_id AND r.i = w.i
), k AS (
  SELECT row_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY row_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row_id)""",
    "op5_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op6_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), t AS (
  SELECT row_id, i, ws[i] AS word, CASE WHEN i + 4 <= len(ws) THEN list_slice(ws, i, i + 4) END AS five FROM (SELECT row_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), r AS (
  SELECT row_id, i, word, five IS NOT NULL AND count(*) OVER (PARTITION BY row_id, five) > 1 AS twice FROM t
), p AS (
  SELECT row_id, word, max(twice::INT) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS repeated FROM r
), words AS (
  SELECT row_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(repeated) AS n_repeat_words FROM p GROUP BY row_id
), lines AS (
  SELECT row_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), measured AS (
  SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\b(PHRASES)\b', ' ', 'g') AS rest,
    len(regexp_extract_all(line, '[|»›•·]')) AS marks, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    row_number() OVER (PARTITION BY row_id, line ORDER BY pos) > 1 AS again
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT *, NOT (marks >= 2 AND marks * 4 >= n) AND (n >= 8 OR regexp_matches(line, '[.!?…;:。！？]')) AND symbols * 10 < chars
    AND NOT (rest <> low AND 2 * len(regexp_extract_all(rest, '[^\x20\x09-\x0D]+')) <= n) AS passes
  FROM measured
), sums AS (
  SELECT row_id, sum(again::INT) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE NOT passes), 0) AS lost_chars,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE passes), '') AS clean_text
  FROM judged GROUP BY row_id
), all_rows AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(clean_text, '') AS clean_text
  FROM d LEFT JOIN words USING (row_id) LEFT JOIN sums USING (row_id)
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM all_rows
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept, lost_chars, sha256(clean_text) AS clean_sha256
FROM failed""".replace("PHRASES", "|".join(BOILERPLATE).replace("'", "''")),
    "op7_warc_salvage": """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d
), r AS (
  SELECT *, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM g
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to FROM r""",
    "op9_block_topk": """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row_id, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row_id <> b.row_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, (row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 5""",
    "op10_chat_snapshots": r"""
WITH t AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), o AS (
  SELECT *, list(row(role, text)) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
    count(*) OVER (PARTITION BY conv_id, alone) AS n_turns
  FROM t
), whole AS (
  SELECT prefix, n_turns, min(conv_id) AS conv_id, min(alone) AS alone, count(*) AS n_copies FROM o WHERE len(prefix) = n_turns GROUP BY prefix, n_turns
), kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.prefix = whole.prefix AND o.n_turns > whole.n_turns)
), lines AS (
  SELECT o.conv_id, o.alone, k.n_turns, k.n_copies, len(o.prefix) AS pos,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line
  FROM o JOIN kept k ON o.conv_id = k.conv_id OR (k.conv_id IS NULL AND o.alone = k.alone)
)
SELECT conv_id, n_turns, n_copies, string_agg(line, '' ORDER BY pos) AS text FROM lines GROUP BY conv_id, alone, n_turns, n_copies""",
    "op11_pii": f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), s AS ({_SQL_PERSONAL}
), near AS (
  SELECT s.*, translate(substring(text, greatest(start_at - {pii.NEAR}, 0) + 1, least(start_at, {pii.NEAR})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS before,
    translate(substring(text, end_at + 1, {pii.NEAR}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS after
  FROM s JOIN d USING (row_id)
), told AS (
  SELECT *, CASE kind {_SQL_CONTEXT} END AS words, '\\b(?:{"|".join(pii.AGAINST)})' AS against FROM near
), scored AS (
  SELECT row_id, kind, start_at, end_at, {[k.score for k in pii.KINDS]}[kind + 1] + CASE WHEN regexp_matches(before, words) OR regexp_matches(after, words) THEN {pii.RAISE} ELSE 0 END
    - CASE WHEN regexp_matches(before, against) OR regexp_matches(after, against) THEN {pii.LOWER} ELSE 0 END AS score FROM told
), kept AS (
  SELECT *, {[k.name for k in pii.KINDS]}[kind + 1] || ':' || start_at || ':' || end_at AS span FROM scored a
  WHERE kind < {pii.BASE} OR score >= {pii.THRESHOLD} AND NOT EXISTS (SELECT 1 FROM s b WHERE b.row_id = a.row_id AND b.kind < {pii.BASE} AND b.start_at < a.end_at AND a.start_at < b.end_at)
), sums AS (
  SELECT row_id, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k.name}" for i, k in enumerate(pii.KINDS))}, string_agg(span, ',' ORDER BY kind, start_at) FILTER (WHERE kind < {pii.BASE}) AS base,
    string_agg(span, ',' ORDER BY kind, start_at) AS spans, string_agg(span || ':' || greatest(0, least(100, score)), ',' ORDER BY kind, start_at) AS scores FROM kept GROUP BY row_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN sums USING (row_id)""",
    "op12_importance": rf"""
WITH tab AS ({_SQL_CRC_TABLE}), texts AS (
  SELECT 'd' || row_number() OVER () AS row_id, doc_id, text FROM documents UNION ALL SELECT 'b' || row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), f AS (
  SELECT row_id, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT row_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), range(1, 4) t(k) WHERE i + k - 1 <= len(ws)
), x AS (
  SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM f)
), y AS (
  SELECT g, list_transform(range(1, length(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1) AS b FROM x
), z AS (
  SELECT g, {_SQL_CRC} % 10000 AS bucket FROM y, tab
), c AS (
  SELECT row_id, bucket, count(*) AS n FROM f JOIN z USING (g) GROUP BY ALL
), n AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE row_id LIKE 'd%'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE row_id LIKE 'b%'), 0)::DOUBLE AS t FROM c GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n
), v AS (
  SELECT row_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN g USING (bucket) GROUP BY row_id
), o AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substring(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN v USING (row_id) WHERE row_id LIKE 'd%'
), p AS (
  SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o
), q AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS most FROM p
)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * most // 100 THEN place END AS rank FROM q""",
    "op13_prefix_trie": f"""
WITH tab AS ({_SQL_CRC_TABLE}), t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS ts FROM t GROUP BY c
), y AS (
  SELECT c, ts, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS b FROM o
), h AS (
  SELECT c, ts, {_SQL_CRC} % 6 AS h FROM y, tab
), r AS (
  SELECT h.c, list_concat(coalesce(o.ts[1:h], []), h.ts[h + 1:]) AS ts FROM h LEFT JOIN o ON o.c = h.c - h.c % 100
), p AS (
  SELECT c, d, ts[1:d] AS k, len(ts) = d AS ends FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)
), n AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, coalesce(length(k[d].text), 0) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY d, k
), e AS (
  SELECT n.*, a.conv_id AS parent_conv_id FROM n LEFT JOIN n a ON a.d = n.d - 1 AND a.k = n.k[1:n.d - 1]
), m AS (
  SELECT d, parent_conv_id AS conv_id, count(*) AS n_children FROM (SELECT d - 1 AS d, parent_conv_id FROM e WHERE d > 0) GROUP BY ALL
), f AS (
  SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN m USING (d, conv_id)
), s AS (
  SELECT a.d, a.conv_id, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens FROM f a JOIN f b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY a.d, a.conv_id
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN s USING (d, conv_id)""",
}
