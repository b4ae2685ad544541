"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import conversation_repair, fingerprints, jaccard_join, language_id, line_dedup, packing, phrases, pii, quality, sampled_pieces, sharding, substring_dedup, vector_dedup
from .common import table, vocabulary

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query(
    "op9_ngram_jaccard_join",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w
        FROM documents
    ), tokens AS (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0
    ), sets AS (
        SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s FROM tokens
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * c >= 85 * (p.n + q.n - c)
    ), reach AS (
        SELECT doc_id AS x, doc_id AS y FROM sizes
        UNION
        SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
    ), parts AS (
        SELECT x, min(y) AS component_id FROM reach GROUP BY x
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN parts ON parts.x = d.doc_id
    """,
)
def op9(spark, sf_dir):
    """Documents linked at a Jaccard similarity of 0.85 on 4-word shingles."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), jaccard_join.Params(words=4, num=85), "op9")


@query("op5_line_dedup", line_dedup.ORACLE)
def op5(spark, sf_dir):
    """Texts without the line chunks that occur earlier in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_chunks(docs).select("doc_id", "text", "n_lines", "lines_removed", "chunks_removed")


@query("op6_packing")
def op6(spark, sf_dir):
    """All documents as pieces in sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.Params(vocabulary("word_bpe_49k.json")))


@query("op10_language_id")
def op10(spark, sf_dir):
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


@query("op3_quality_ranking")
def op3(spark, sf_dir):
    """Bradley-Terry quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="op3")


@query("op2_pii")
def op2(spark, sf_dir):
    """Spans of personal data in every document."""
    return pii.report(table(spark, sf_dir, "documents"), label="op2")


@query("op8_lz_fingerprints")
def op8(spark, sf_dir):
    """Lempel-Ziv fingerprints of every text, its edit and its successor."""
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


@query("op7_lpt_sharding")
def op7(spark, sf_dir):
    """All documents in 8 shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query(
    "op1_embedding_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    ), good AS (
        SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9
    ), reach AS (
        SELECT vec_id AS x, vec_id AS y FROM v
        UNION
        SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
    ), parts AS (
        SELECT x, min(y) AS component_id FROM reach GROUP BY x
    ), n AS (
        SELECT x, count(*) AS n_links FROM links GROUP BY x
    )
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN parts ON parts.x = vec_id LEFT JOIN n ON n.x = vec_id
    """,
)
def op1(spark, sf_dir):
    """Vectors linked at cosine 0.9, by p-stable hashing."""
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), label="op1")


@query("op4_sampled_pieces")
def op4(spark, sf_dir):
    """Reproducibly sampled pieces of every text, checked to decode to it."""
    return sampled_pieces.encode(table(spark, sf_dir, "documents"), sampled_pieces.Params(vocabulary("piece_bpe_32k.model")))


@query("op11_conversation_repair", conversation_repair.ORACLE)
def op11(spark, sf_dir):
    """Faults and cheapest repair of every damaged conversation."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversations, conversation_repair.damage(conversations), label="op11")


@query("op12_substring_dedup", substring_dedup.ORACLE)
def op12(spark, sf_dir):
    """Words left of every document after repeated passages of 50 words and more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, label="op12")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_phrase_collocations", phrases.ORACLE)
def op13(spark, sf_dir):
    """Each language's first 2000 phrases of 2 to 5 words by their score."""
    return phrases.collocations(table(spark, sf_dir, "documents"), label="op13")
