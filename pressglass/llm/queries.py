"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressglass.llm import bpe, chaining, collocations, crf, jaccard, merkle, naming, pii, planes, sharding, suffixes, warc, winnow
from pressglass.llm.common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col):
    """Rows that the quality classifier never learns from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def quality_field(spark: SparkSession, sf_dir: str) -> crf.LineField:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return crf.train(documents(spark, sf_dir), labels.where(~held_out(F.col("doc_id"))))


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf.score(documents(spark, sf_dir), quality_field(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")


def op2_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(documents(spark, sf_dir))


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"))


def op5_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end_id=2, special_as_text=False)


def op6_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t
      WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op10_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.proofs(documents(spark, sf_dir), {"text": found})


OP11_SQL = r"""
WITH RECURSIVE v AS (SELECT *, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, 3988292384 * (c % 2)) END) AS crc FROM documents),
o AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS found FROM v),
e AS (SELECT doc_id, source, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS text, coalesce(octet_length(encode(found)) || ':' || found, '-') AS found FROM o),
d AS (SELECT doc_id, source, sha256(head || text) AS leaf, sha256(head || found) AS found FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM d),
s AS (SELECT source, 0 AS lev, list(leaf ORDER BY pos) AS l FROM r GROUP BY source
  UNION ALL SELECT source, lev + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], ''))) FROM s WHERE len(l) > 1),
u AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM s WHERE len(l) = 1),
t AS (SELECT 0 AS lev, list(subroot ORDER BY pos) AS l FROM u
  UNION ALL SELECT lev + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], ''))) FROM t WHERE len(l) > 1),
a AS (SELECT r.doc_id, r.leaf, r.found, u.subroot, s.lev, s.l, (r.pos // (3 ** s.lev)::BIGINT) AS p FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source JOIN s ON r.source IS NOT DISTINCT FROM s.source WHERE len(s.l) > 1
  UNION ALL SELECT r.doc_id, r.leaf, r.found, u.subroot, 1000 + t.lev, t.l, (u.pos // (3 ** t.lev)::BIGINT) FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source JOIN t ON len(t.l) > 1),
b AS (SELECT doc_id, leaf, found, subroot, lev, array_to_string(l[p - p % 3 + 1:p], '') AS lft, array_to_string(l[p + 2:p - p % 3 + 3], '') AS rgt FROM a),
f AS (SELECT doc_id, leaf, subroot, sha256(string_agg(lft || rgt, '' ORDER BY lev)) AS proof_sha256,
    list_reduce([found] || list(lft || '|' || rgt ORDER BY lev), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root FROM b GROUP BY doc_id, leaf, found, subroot)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f, (SELECT l[1] AS root FROM t WHERE len(l) = 1)
"""


def op12_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir))


OP12_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM h WHERE len(h) >= 800)),
m AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
s AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 400 THEN 0 ELSE 1 END AS opens FROM g SEMI JOIN m USING (g) WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, min(p) AS b, max(p) + 400 AS e FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s) GROUP BY doc_id, run),
c AS (SELECT doc_id, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es, sum(e - b) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, coalesce(n_spans, 0) + 2), lambda i: substr(h, 2 * coalesce(es[i - 1], 0) + 1, 2 * (coalesce(bs[i], len(h) // 2) - coalesce(es[i - 1], 0)))), ''))) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k AS m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2),
x AS (SELECT c.lang, c.phrase, c.a, x.k, x.l, x.r FROM (SELECT c.lang, c.phrase, c.a, cut.k, f1.f AS l, f2.f AS r FROM c, range(1, 5) AS cut(k)
  JOIN f AS f1 ON f1.lang = c.lang AND f1.phrase = array_to_string(c.ws[1:cut.k], ' ') JOIN f AS f2 ON f2.lang = c.lang AND f2.phrase = array_to_string(c.ws[cut.k + 1:], ' ') WHERE cut.k < c.m) AS x JOIN c USING (lang, phrase)),
s AS (SELECT lang, phrase, a, l, r, n, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score, k FROM x JOIN n USING (lang)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS within FROM (SELECT lang, ws, a, k, unnest(range(1, m - k + 2)) AS i FROM c, range(2, 5) AS t(k) WHERE k < m) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE 100 * coalesce(within, 0) < 100 * a),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_crf, op2_collinear_chains, op3_bpe_transducer, op4_winnowing, op5_id_planes, op6_block_naming, op7_minimax_shards, op8_warc_index, op9_pii, op10_jaccard_regions, op11_merkle_climb, op12_suffix_family, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op4_winnowing": OP4_SQL, "op6_block_naming": OP6_SQL, "op11_merkle_climb": OP11_SQL, "op12_suffix_family": OP12_SQL, "op13_collocations": OP13_SQL}
