"""Queries of the training-data operators: one opN_<name> each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import core, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.source_mix import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.hamming_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=10)


def op4_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.histogram_shard import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.best_fit_pack import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.substring_fm import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.line_crf import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.exact_dedup import duplicate_groups

    return duplicate_groups(core(table(spark, sf_dir, "documents"))).withColumnRenamed("digest", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.code_compression import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_feature_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.feature_resampling import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinwork.llm.cap_filters import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_source_mix, op3_hamming_topk, op4_histogram_shard, op5_best_fit_pack, op6_substring_fm, op7_line_crf, op8_ngram_join, op9_exact_dedup, op10_toxicity,
        op11_code_compression, op12_feature_resampling, op13_cap_filters,
    )
}


def codes_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """The fit of op11, a step for each round."""

    def nearest(name: str, books: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS m FROM (
            SELECT v.vec_id, v.p, c.e, CAST(list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
            FROM cut v JOIN {books} c USING (p)) GROUP BY vec_id, p)"""

    steps = []
    for k in range(rounds):
        steps += [nearest(f"a{k}", f"c{k}"), f"""c{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (
            SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
                SELECT v.p, a.m.e AS e, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS n FROM cut v JOIN a{k} a USING (vec_id, p), range(1, 9) r(i) GROUP BY v.p, a.m.e, i)
            GROUP BY p, e) n USING (p, e))"""]
    return f"""
        WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (SELECT vec_id, p, v[CAST(p * len(v) // {parts} + 1 AS BIGINT):CAST((p + 1) * len(v) // {parts} AS BIGINT)] AS x FROM kept, range({parts}) r(p)),
        c0 AS MATERIALIZED (SELECT c.p, s.e, c.x AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) s JOIN cut c USING (vec_id)),
        {", ".join(steps)}, {nearest("a", f"c{rounds}")},
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a GROUP BY vec_id)
        SELECT k.vec_id, k.label, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded c JOIN kept k USING (vec_id), digest"""


def resampling_sql(buckets: int = 10_000) -> str:
    """The weights of op12; crc32 by its table, which follows from the polynomial."""
    byte = "list_reduce([CAST({b} AS BIGINT), 0, 1, 2, 3, 4, 5, 6, 7], lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return f"""
        WITH crc AS MATERIALIZED (SELECT list({byte.format(b="b")} ORDER BY b) AS t FROM range(256) r(b)),
        texts AS MATERIALIZED (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        words AS MATERIALIZED (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
        features AS MATERIALIZED (SELECT kind, id, f, count(*) AS n FROM (
            SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words)
            GROUP BY ALL),
        dictionary AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, CAST(strlen(f) AS BIGINT)), lambda i: CAST(('0x' || hex(encode(f))[2 * i + 1:2 * i + 2]) AS BIGINT))),
                lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256)), 4294967295) % {buckets} AS bucket FROM (SELECT DISTINCT f FROM features), crc),
        sums AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM features JOIN dictionary USING (f) GROUP BY bucket),
        totals AS (SELECT sum(s) AS s, coalesce(sum(t), 0) AS t FROM sums),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(x.t, 0) + 1) * (y.s + {buckets}) AS DOUBLE) / CAST((coalesce(x.s, 0) + 1) * (y.t + {buckets}) AS DOUBLE))) AS BIGINT) AS g FROM sums x, totals y),
        weights AS (SELECT id, sum(n) AS n_features, sum(n * g) AS weight FROM features JOIN dictionary USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
        scored AS (SELECT w.id AS doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || sha256('42:' || w.id)[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM words w LEFT JOIN weights x ON w.id = x.id WHERE kind = 'd'),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
        SELECT s.doc_id, n_features, weight, score, r AS rank FROM scored s LEFT JOIN (SELECT * FROM ranked WHERE r <= 5 * n // 100) USING (doc_id)"""


ORACLE_SQL = {
    "op11_code_compression": codes_sql(),
    "op12_feature_resampling": resampling_sql(),
    "op13_cap_filters": """
        WITH RECURSIVE good AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
        least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT l.vec_id, coalesce(n, 0) AS n_links, component_id, l.vec_id = component_id AS kept FROM least l LEFT JOIN degree USING (vec_id)""",
    "op3_hamming_topk": """
        WITH bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
              CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
              FROM bits q, bits v WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance
        FROM d QUALIFY rank <= 10""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size, min_by(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)""",
}
