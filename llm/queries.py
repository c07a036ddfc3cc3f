"""The registered queries: each maps given tables to an operator's records and its results back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import chunking, density, lines, mixing, nearest, negatives, packing, prefix_trie, quality, search, simhash, syncmers, urls
from llm.common import checkpointed, texts
from llm.ordering import ring, ring_window


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _page_texts(documents: DataFrame) -> DataFrame:
    """Documents as page texts: the whole text of every row."""
    return documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("data"))


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text, whose second half is the beginning of the next document."""
    placed = ring(texts(_page_texts(_documents(spark, sf_dir)), "page_id"), "page_id")
    ordered = ring_window("page_id", "data")
    half = F.floor(F.length("data") / 2).cast("int")
    following = F.when(F.col("page_id").isNull(), "").otherwise(F.coalesce(F.lead("data").over(ordered), F.lit("")))
    edited = placed.withColumn("following", following).where("ring_turn = 0").select(
        "page_id", "data", "following", F.length("data").cast("long").alias("n_chars"),
        F.concat(F.expr("substring(data, 1, length(data) - int(floor(length(data) / 2)))"),
                 F.substring("following", F.lit(1), half)).alias("edited"))
    printed = edited.select(
        F.col("page_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(
            syncmers.fingerprint_of(text).alias(name)
            for text, name in (("data", "fingerprint"), ("edited", "edited_fingerprint"), ("following", "next_fingerprint"))))
    return printed.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        syncmers.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        syncmers.likeness("fingerprint", "next_fingerprint").alias("near_next"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`page_id`, `score`, `predicted`; labels of held-out rows are never read."""
    known = labels.where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "FAIL").alias("validation_state"))
    measured = checkpointed(quality.page_statistics(_page_texts(documents)))
    return quality.score(measured, quality.fit(measured, known))


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(F.col("page_id").alias("doc_id"), held_out(F.col("page_id")).alias("held_out"), "score", "predicted")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_page_texts(_documents(spark, sf_dir))).withColumnRenamed("page_id", "doc_id")


def op4_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = lines.line_classes(_page_texts(_documents(spark, sf_dir)))
    return classes.withColumnsRenamed({"page_id": "doc_id", "first_page_id": "first_doc_id"})


#: How far the mixture goes towards equal weights, and how often it may use its smallest sources for once through its largest.
MIX_ENTROPY, MIX_REPETITION = 0.95, 4.0


def op5_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _documents(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.col("source").alias("host"), mixing.tokens_of("text").alias("tokens"))
    mixed = mixing.mix(pages, target_entropy=MIX_ENTROPY, max_repetition=MIX_REPETITION)
    return mixed.select("page_id", "host", "tokens", "block", "position", F.round("weight", 6).alias("weight")).withColumnsRenamed(
        {"page_id": "doc_id", "host": "source"})


def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_pieces(_page_texts(_documents(spark, sf_dir)), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("page_id", "doc_id")


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = chunking.repeated_spans(_page_texts(_documents(spark, sf_dir)))
    return spans.withColumnsRenamed({"page_id": "doc_id", "first_page_id": "first_doc_id"})


def op7_repeated_spans_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `op7_repeated_spans`, with spans to their true ends and the length asked of those."""
    spans = chunking.extended_spans(_page_texts(_documents(spark, sf_dir)))
    return spans.withColumnsRenamed({"page_id": "doc_id", "first_page_id": "first_doc_id"})


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.main_texts(_pages(spark, sf_dir))


def op9_bm25_top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 asks, with its whole text, all documents."""
    pages = _page_texts(_documents(spark, sf_dir))
    return search.search(pages, pages.where("page_id % 100 = 0")).withColumnsRenamed({"query_id": "query_doc_id", "page_id": "doc_id"})


#: Fixed by the contract of the query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(urls.labelled_urls(), "url string, verdict string")
    return urls.judge(_pages(spark, sf_dir), URL_RULES, urls.train(labelled))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector stands for an element, its label for the kind; every seventh label is moved on by one."""
    elements = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("element_ref"), F.col("embedding").alias("measures"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("element_kind"))
    found = negatives.hard_negatives(elements, F.col("element_ref") % 50 == 0, scale=256.0)
    return found.withColumnsRenamed({"anchor_ref": "anchor_id", "positive_ref": "positive_id", "negative_ref": "negative_id"})


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector stands for an element; those whose id is divisible by 50 ask all others."""
    elements = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("element_ref"), F.col("embedding").alias("measures"))
    found = nearest.nearest_elements(elements, F.col("element_ref") % 50 == 0)
    return found.withColumnsRenamed({"query_ref": "query_id", "element_ref": "vec_id"})


def op13_conversation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of rebuilt conversations: a conversation stands for a page, a turn for a segment."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("position"), F.col("role").alias("kind"), F.col("text").alias("segment"))
    ranked = checkpointed(prefix_trie.ranked_segments(turns))
    lengths = ranked.where("depth = 1").select("page_id", F.col("n_segments").alias("_own"))
    sized = lengths.withColumns({"_taken": F.crc32(F.col("page_id").cast("string")) % 6, "_base": F.col("page_id") - F.col("page_id") % 100}).join(
        lengths.select(F.col("page_id").alias("_base"), F.col("_own").alias("_there")), "_base", "left")
    sized = checkpointed(sized.withColumn("_given", F.least("_taken", F.coalesce("_there", F.lit(0)))).select(
        "page_id", "_base", "_taken", "_given", (F.col("_given") + F.greatest(F.col("_own") - F.col("_taken"), F.lit(0))).cast("int").alias("n_segments")))
    columns = ("page_id", "depth", "kind", "segment", "n_segments")
    heads = ranked.where("depth <= 5").select(F.col("page_id").alias("_base"), "depth", "kind", "segment")
    given = sized.join(heads, "_base").where("depth <= _given").select(*columns)
    own = ranked.drop("n_segments").join(sized, "page_id").where("depth > _taken").withColumn("depth", (F.col("depth") - F.col("_taken") + F.col("_given")).cast("int"))
    tree = prefix_trie.tree_of_ranked(sized.select("page_id"), given.unionByName(own.select(*columns)))
    return tree.withColumnsRenamed({"page_id": "conv_id", "parent_page_id": "parent_conv_id", "n_pages": "n_convs", "saved_chars": "saved_tokens"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
    "op2_quality_scores": op2_quality_scores,
    "op3_simhash_near_duplicates": op3_simhash_near_duplicates,
    "op4_line_classes": op4_line_classes,
    "op5_source_mixture": op5_source_mixture,
    "op6_packed_sequences": op6_packed_sequences,
    "op7_repeated_spans": op7_repeated_spans,
    "op7_repeated_spans_extended": op7_repeated_spans_extended,
    "op8_main_text": op8_main_text,
    "op9_bm25_top_pages": op9_bm25_top_pages,
    "op10_url_verdicts": op10_url_verdicts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest_vectors": op12_nearest_vectors,
    "op13_conversation_tree": op13_conversation_tree,
}

LINE_CLASSES_SQL = r"""
WITH RECURSIVE occurrence AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS n(i)
  WHERE regexp_replace(parts[i], '[\x20\x09-\x0D]+', '', 'g') <> ''
), line AS (
  SELECT line, row_number() OVER (ORDER BY line) AS node FROM (SELECT DISTINCT line FROM occurrence)
), hole AS (
  SELECT node, p, substring(line, 1, p - 1) || substring(line, p + 1) AS rest
  FROM line, unnest(range(1, length(line) + 1)) AS h(p) WHERE length(line) >= 48
), link AS (
  SELECT DISTINCT min(node) OVER (PARTITION BY p, rest) AS a, node AS b FROM hole
  UNION SELECT line.node, hole.node FROM hole JOIN line ON hole.rest = line.line WHERE length(line.line) >= 48
), both_ways AS (
  SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), classed AS (
  SELECT doc_id, line_no, least(node, coalesce(lowest, node)) AS class FROM occurrence JOIN line USING (line)
  LEFT JOIN (SELECT a, min(b) AS lowest FROM reach GROUP BY a) ON a = node
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first_value(doc_id) OVER w AS first_doc_id, CAST(first_value(line_no) OVER w AS INTEGER) AS first_line_no,
       count(*) OVER (PARTITION BY class) AS class_lines, row_number() OVER w = 1 AS kept
FROM classed WINDOW w AS (PARTITION BY class ORDER BY doc_id, line_no)
"""

SOURCE_MIXTURE_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents
), total AS (
  SELECT source, count(*) AS pages, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) / sum(sum(tokens)) OVER () AS share FROM doc GROUP BY source
), step(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN enough THEN (low + high) / 2 ELSE low END, CASE WHEN enough THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high, (
    SELECT ln(sum(pow(share, (low + high) / 2))) - sum(pow(share, (low + high) / 2) * ln(pow(share, (low + high) / 2))) / sum(pow(share, (low + high) / 2))
             >= 0.95 * ln(count(*))
        OR max(pow(share, (low + high) / 2) / share) / min(pow(share, (low + high) / 2) / share) > 4 FROM total WHERE tokens > 0) AS enough
    FROM step WHERE i < 24)
), ends AS (
  SELECT CASE WHEN (SELECT ln(count(*)) * 0.95 <= -sum(share * ln(share)) FROM total WHERE tokens > 0) THEN 1.0
              WHEN (SELECT max(pow(share, low) / share) / min(pow(share, low) / share) FROM total WHERE tokens > 0) > 4 THEN high ELSE low END AS e
  FROM step WHERE i = 24
), weighted AS (
  SELECT source, pages, tokens, pow(share, e) / sum(pow(share, e)) OVER () AS weight FROM total, ends
), budgeted AS (
  SELECT source, tokens AS whole, weight, greatest(tokens, CAST(floor(weight * max(tokens / weight) OVER () + 0.5) AS BIGINT)) AS budget FROM weighted
), placed AS (
  SELECT doc_id, source, tokens, block, weight, sha256('0' || chr(31) || block || chr(31) || doc_id) AS position, budget // whole AS n_full, budget % whole AS rest
  FROM doc JOIN budgeted USING (source), unnest(range(0, budget // whole + CASE WHEN budget % whole > 0 THEN 1 ELSE 0 END)) AS b(block)
), running AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY position, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
  FROM placed
)
SELECT doc_id, source, tokens, CAST(block AS INTEGER) AS block, position, round(weight, 6) AS weight FROM running WHERE block < n_full OR reached < rest
"""

TOP_PAGES_SQL = r"""
WITH token AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS n FROM token GROUP BY ALL
), size AS (
  SELECT doc_id, sum(n) AS length FROM counts GROUP BY doc_id
), whole AS (
  SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM token) AS tokens
), idf AS (
  SELECT term, ln(1 + (pages - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counts, whole GROUP BY term, pages
), scored AS (
  SELECT q.doc_id AS query_doc_id, d.doc_id, round(sum(q.n * idf * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * length / (tokens / pages)))), 6) AS score
  FROM counts q JOIN counts d USING (term) JOIN idf USING (term) JOIN size ON size.doc_id = d.doc_id, whole
  WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_doc_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_doc_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

HARD_NEGATIVES_SQL = r"""
WITH vector AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vector a JOIN vector b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

CONVERSATION_TREE_SQL = r"""
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), conv AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c))), lambda crc, byte:
           list_reduce(list_concat([xor(crc, byte)], [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM (SELECT DISTINCT conv_id FROM turn)
), taken AS (
  SELECT conv_id, base, xor(crc, 4294967295) % 6 AS h FROM conv
), rebuilt AS (
  SELECT t.conv_id, place, role, text FROM taken t JOIN turn ON turn.conv_id = t.base WHERE place <= h
  UNION ALL SELECT turn.conv_id, place, role, text FROM turn JOIN taken t USING (conv_id) WHERE place > h
), step AS (
  SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS len, length(text) AS chars,
         list({'role': role, 'text': text}) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, coalesce(len, 0), 0, [] FROM taken LEFT JOIN (SELECT conv_id, count(*) AS len FROM rebuilt GROUP BY conv_id) USING (conv_id)
), node AS (
  SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, max(len) = depth AS leaf, max(chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN len = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM step GROUP BY depth, prefix
), placed AS (
  SELECT step.conv_id, node.* FROM step JOIN node USING (depth, prefix)
), owned AS (
  SELECT conv_id, depth, node, sum(CASE WHEN conv_id = node AND leaf THEN 1 ELSE 0 END) OVER w AS leaves,
         sum(CASE WHEN conv_id = node THEN (n_convs - 1) * chars ELSE 0 END) OVER w AS saved, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY depth DESC)
), below AS (
  SELECT node, depth, min(parent) AS parent, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens FROM owned GROUP BY node, depth
), child AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM below GROUP BY ALL
)
SELECT node AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM node JOIN below USING (node, depth) LEFT JOIN child USING (node, depth)
"""

#: The others need a tokenizer, XXH64, a rolling hash, a trained model or the tree of a page: tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_line_classes": LINE_CLASSES_SQL,
    "op5_source_mixture": SOURCE_MIXTURE_SQL,
    "op9_bm25_top_pages": TOP_PAGES_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_conversation_tree": CONVERSATION_TREE_SQL,
}
