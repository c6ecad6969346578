"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, exact_dedup, jaccard, lexicon, middles, neighbours, packing, quality, records, separators, sharding, substrings, toxicity

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    out = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), 24)
    return out.select(
        "doc_id", sharding.sizes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its group of equal texts; the largest doc_id stays."""
    return exact_dedup.dedup(documents(spark, sf_dir))


ORACLE_SQL["op8_chunk_recipes"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op3_transducer_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the transducer, and the text decoded from them."""
    df = documents(spark, sf_dir)
    out = lexicon.decode(lexicon.encode(df, BYTE_BPE), BYTE_BPE)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document starts in flat token files, and how many ids it has with its separator."""
    return separators.token_counts(documents(spark, sf_dir), BYTE_BPE, 50256)


@query
def op9_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of a document with its sequence of at most 1024 tokens."""
    out = packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, end_id=2, capacity=1024)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record files give back: each document's place and ids."""
    out = records.read(records.write(documents(spark, sf_dir), WORD_BPE, end_id=1))
    return out.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op6_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated windows of 20 words."""
    out = substrings.dedup(documents(spark, sf_dir), 20)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles of 3 words and its component at a similarity of 0.9."""
    return jaccard.join(documents(spark, sf_dir), n=3, num=9, den=10)


@query
def op2_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    df = documents(spark, sf_dir)
    model = toxicity.fit(df, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(df, model, carry=["doc_id"])
    return out.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@query
def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


@query
def op11_codepoint_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut for filling in its middle, and what is rebuilt from that."""
    out = middles.transform(documents(spark, sf_dir), carry=["doc_id"])
    sha = lambda c: F.sha2(c, 256)
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha(middles.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL["op11_codepoint_middles"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


@query
def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    found = quality.statistics(documents(spark, sf_dir), carry=["doc_id"])
    model = quality.fit(found, F.col("row.doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(found, model).select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query
def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, by codebooks of two rounds."""
    codes, books = codebooks.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256, carry=["vec_id", "label"])
    out = codebooks.with_label_errors(codes, F.col("row.label"))
    return out.select("row.vec_id", "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


LLOYD_ROUND = """
a{0} AS (SELECT vec_id, p, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
  SELECT v.vec_id, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN c{0} c ON v.p = c.p) GROUP BY vec_id, p),
"""
LLOYD_BOOK = """
m{1} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (SELECT a.p, a.e, i, sum(v.x[i]) AS s, count(*) AS n FROM a{0} a JOIN v ON v.vec_id = a.vec_id AND v.p = a.p, unnest(range(1, len(v.x) + 1)) t(i) GROUP BY a.p, a.e, i) GROUP BY p, e),
c{1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN m{1} m ON m.p = c.p AND m.e = c.e),
"""
ORACLE_SQL["op13_filtering_lloyd"] = (
    """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM k, range(16) t(p)),
c0 AS (SELECT v.p, r.e, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64) r ON r.vec_id = v.vec_id),"""
    + LLOYD_ROUND.format(0) + LLOYD_BOOK.format(0, 1) + LLOYD_ROUND.format(1) + LLOYD_BOOK.format(1, 2) + LLOYD_ROUND.format(2)
    + """
r AS (SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(a.e)), 2, '0'), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM k JOIN a2 a ON a.vec_id = k.vec_id GROUP BY k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256 FROM r
"""
)

ORACLE_SQL["op6_super_kmers"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
s AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.k) FILTER (WHERE gone.k IS NULL) AS kept, count(gone.k) AS n_removed FROM o LEFT JOIN gone ON o.doc_id = gone.doc_id AND o.k = gone.k GROUP BY o.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

ORACLE_SQL["op7_token_groups"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, t FROM (
  SELECT doc_id, array_to_string(w[i + 1:i + 3], ' ') AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
