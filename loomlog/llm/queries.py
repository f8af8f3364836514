"""The numbered queries over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import burst_trie, class_lm, disclosure, exact_dedup, graph_ann, hard_negatives, licenses, mixing, near_dedup, packing, quality, swap_packing, toxicity
from loomlog.llm.common import held_out, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle.strip()
        return function

    return add


@query(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.new_index(spark).add(table(spark, sf_dir, "documents"))


@query(
    """
    WITH docs AS (
      SELECT doc_id, source, coalesce('=' || source, '') AS key,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
      FROM documents),
    sums AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM docs GROUP BY key, source),
    weighed AS (
      SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sums),
    filled AS (
      SELECT *, source_size * 2.0::DOUBLE AS cap,
             (sum(source_size) OVER () * 1.5::DOUBLE
                - coalesce(sum(source_size * 2.0::DOUBLE) OVER earlier, 0.0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS step
      FROM weighed
      WINDOW earlier AS (ORDER BY source_size * 2.0::DOUBLE / weight, place
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
      SELECT key, source_size, least(cap, max(step) OVER () * weight) AS target FROM filled),
    ranked AS (
      SELECT d.*, t.source_size, t.target,
             row_number() OVER (
               PARTITION BY d.key
               ORDER BY size, coalesce(doc_id, 0) % (1 + (SELECT count(*) FROM docs) // 1024), doc_id
             ) AS place,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || md5('0:' || coalesce(source, chr(0)))[1:8])::BIGINT / 4294967296.0::DOUBLE
               AS start
      FROM docs d JOIN targets t USING (key))
    SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
           (size * (floor(place * rate + start) - floor((place - 1) * rate + start)))::BIGINT AS taken
    FROM ranked
    """
)
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sample_copies(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return drawn.select("doc_id", "size", "source_size", "target", taken)


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").where(~held_out(4, 2))
    scored = toxicity.score(docs, toxicity.fit(docs, labelled))
    return scored.select(
        "doc_id",
        held_out(4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "evidence",
    )


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "window", "step_group",
    )


@query()
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m.base)
    starts = F.transform(base, lambda m: m.first_word)
    labels = lambda matches: F.array_join(
        F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ","
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.when(F.exists("matches", lambda m: ~m.base), 1.0)
        .when(F.size("matches") > 0, 0.5)
        .otherwise(0.0)
        .alias("score"),
        "matches",
    )


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").where(~held_out(5, 0))
    scored = quality.score(docs, quality.fit(docs, labelled))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", predicted)


@query()
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "first")


@query()
def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = class_lm.score(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return scored.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


@query()
def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(graph_ann.valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "ann-rows")
    index = graph_ann.build_index(vectors, keep=6)
    found = graph_ann.search(index, vectors.where("id % 50 = 0"), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query()
def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(table(spark, sf_dir, "documents"))
    counts = [disclosure.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in disclosure.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(disclosure.written(F.col("base")), 256).alias("base_sha256"),
        disclosure.written(F.array_sort(F.concat("base", "terms"))).alias("spans"),
    )


@query()
def op12_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = swap_packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query(
    """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
             list_dot_product(a.v, r.v)::BIGINT AS score
      FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id != a.vec_id AND len(a.v) = len(r.v)),
    positives AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
           (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5
    """
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored(hard_negatives.valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label), "negative-rows")
    miner = hard_negatives.Miner(rows)
    anchors = rows.where("id % 100 = 0")
    return miner.mine(anchors, miner.positives(anchors, k=5), k=5, share=(80, 100))


@query(
    """
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32]
               || printf('%08X', strlen(coalesce(text, ''))) AS id
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
      SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids,
             list_reduce(
               list_prepend(4294967295, flatten(list_transform(
                 range(1, len(conv_id::VARCHAR) + 1),
                 lambda i: [ascii((conv_id::VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
             ) AS crc
      FROM turns GROUP BY conv_id),
    rebuilt AS (
      SELECT o.conv_id,
             list_concat(coalesce(b.ids[:(xor(o.crc, 4294967295) % 9)], []), o.ids[xor(o.crc, 4294967295) % 9 + 1:]) AS ids
      FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
    prefixes AS (
      SELECT conv_id, unnest(range(len(ids) + 1)) AS depth, ids FROM rebuilt),
    nodes AS (
      SELECT depth, sha256(array_to_string(ids[:depth], '')) AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
             any_value(sha256(array_to_string(ids[:depth - 1], ''))) AS up, any_value(ids[:depth]) AS path,
             string_agg(CASE WHEN len(ids) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends,
             any_value(CASE WHEN depth > 0 THEN ('0x' || ids[depth][33:])::BIGINT ELSE 0 END) AS bytes
      FROM prefixes GROUP BY 1, 2),
    counted AS (
      SELECT n.*, count(k.node) AS n_children
      FROM nodes n LEFT JOIN nodes k ON k.depth = n.depth + 1 AND k.up = n.node
      GROUP BY ALL),
    above AS (
      SELECT unnest(list_transform(range(depth + 1), lambda d: {'depth': d, 'node': sha256(array_to_string(path[:d], ''))}),
                    recursive := true),
             n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved
      FROM counted),
    sums AS (
      SELECT depth, node, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM above GROUP BY depth, node)
    SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens,
           sha256(coalesce(c.ends, '')) AS ends_sha256
    FROM counted c JOIN sums s USING (depth, node) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.up
    """
)
def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = burst_trie.sequences(table(spark, sf_dir, "conversations"))
    count = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return burst_trie.trie(burst_trie.with_shared_beginnings(own, 5, count.cast("int")))
