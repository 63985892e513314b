"""The registered queries of the numbered operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import rendered
from .common import table
from .extract import main_text
from .importance import resampled
from .jaccard import near_copies
from .latent import leaks
from .packing import pack
from .pivots import near_vectors
from .prefix_trie import prefix_trie
from .suffix_index import without_repeats
from .target_resampling import resampled as target_resampled
from .token_archive import archived
from .vector_packing import pack_documents
from .warc import archived as warc_archived


def op1_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "kept")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archived(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_archive": op1_token_archive,
    "op2_importance": op2_importance,
    "op3_chat_format": op3_chat_format,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_pivot_neighbours": op9_pivot_neighbours,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_packing": op11_vector_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_target_resampling": op13_target_resampling,
}
_BITS = "".join(f"{i:04b}" for i in range(16))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE32 = _UPPER + "234567"
_CRC = "list_reduce(list_prepend(4294967295, flatten(list_transform(range(octet_length({0})), lambda i: [16 * (instr('0123456789ABCDEF', substr(hex({0}), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex({0}), 2 * i + 2, 1)) - 1, 0, 0, 0, 0, 0, 0, 0]))), lambda c, y: xor(xor(c, y) >> 1, 3988292384 * (xor(c, y) & 1)))"
_VALUE = " + ".join(f"{1 << (4 - k)} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INT)" for k in range(5))

#: The numbered operators without an entry here have no SQL: token ids, fitted models, packing, and repeats by the byte. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": """WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS n, concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) AS one, string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '') OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, n = max(n) OVER (PARTITION BY conv_id) AS final FROM p),
k AS (SELECT min(conv_id) AS conv_id FROM f WHERE final AND s NOT IN (SELECT s FROM f WHERE NOT final) GROUP BY s)
SELECT conv_id, CAST((n - 1) // 256 AS INT) AS part, CAST(count(*) AS INT) AS n_turns, string_agg(one, '' ORDER BY n) AS text FROM p WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY 1, 2""",
    "op5_warc": f"""SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + {_VALUE}, 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last,
      list_aggregate(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: substr('{_BITS}', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), 'string_agg', '') AS bits FROM pages)""",
    "op8_html_extract": r"""WITH b AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
t AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM b),
j AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM j""",
    "op9_pivot_neighbours": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS label FROM v UNION SELECT l.y, r.label FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(label) AS component_id FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.x = c.id""",
    "op10_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x20]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(list_slice(l, i, i + 4), ' ')) END) AS g FROM w WHERE len(l) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT k.x, k.y FROM k JOIN c a ON a.doc_id = k.x JOIN c b ON b.doc_id = k.y WHERE 5 * k.n >= 4 * (a.n + b.n - k.n)),
r AS (SELECT doc_id AS id, doc_id AS label FROM documents UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.id)
SELECT r.id AS doc_id, min(r.label) AS class_id, any_value(coalesce(n.n, 0)) AS n_links FROM r LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY x) n ON n.x = r.id GROUP BY r.id""",
    "op12_prefix_trie": rf"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, encode(CAST(conv_id AS VARCHAR)) AS digits FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC.format("digits")}, 4294967295) % 4 AS h FROM i),
r AS (SELECT c.conv_id, j, said FROM c JOIN t ON t.conv_id = base AND j <= h UNION ALL SELECT conv_id, j, said FROM c JOIN t USING (conv_id) WHERE j > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list(said) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY j) UNION ALL SELECT conv_id, 0, CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]) FROM c),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')) END AS saves FROM m GROUP BY depth, path),
k AS (SELECT a.depth, a.path, b.depth AS below, b.saves, b.conv_id AS child FROM n a JOIN n b ON b.depth >= a.depth AND list_slice(b.path, 1, a.depth) = a.path),
s AS (SELECT depth, path, count(*) FILTER (below = depth + 1) AS n_children, CAST(sum(saves) AS BIGINT) AS saved_tokens FROM k GROUP BY depth, path),
l AS (SELECT a.depth, a.path, count(*) AS n_leaves FROM s a JOIN s b ON b.n_children = 0 AND b.depth >= a.depth AND list_slice(b.path, 1, a.depth) = a.path GROUP BY a.depth, a.path)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, s.n_children, l.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, path) JOIN l USING (depth, path) LEFT JOIN n q ON n.depth > 0 AND q.depth = n.depth - 1 AND list_slice(n.path, 1, n.depth - 1) = q.path""",
    "op13_target_resampling": rf"""WITH d AS (SELECT doc_id, TRUE AS raw, text FROM documents UNION ALL SELECT NULL, FALSE, text FROM benchmark),
w AS (SELECT *, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM d),
f AS (SELECT doc_id, raw, unnest(l) AS word FROM w),
k AS (SELECT word, xor({_CRC.format("encode(word)")}, 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM f)),
b AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM f JOIN k USING (word) GROUP BY bucket),
a AS (SELECT count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM f),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(b.t + 1 AS DOUBLE) * (a.s + 10000) / (CAST(b.s + 1 AS DOUBLE) * (a.t + 10000)))) AS BIGINT) AS gain FROM b, a),
x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (word) JOIN g USING (bucket) WHERE raw GROUP BY doc_id),
h AS (SELECT doc_id, list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', substr(sha256(concat('2024:', doc_id)), i, 1)) - 1 AS BIGINT)), lambda p, q: 16 * p + q) AS h, len(l) AS n FROM w WHERE raw),
y AS (SELECT h.doc_id, n AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h LEFT JOIN x ON x.doc_id = h.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS most FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= most THEN place END AS rank FROM r""",
}
