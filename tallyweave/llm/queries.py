"""Queries of problems 2 to 9, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt
from ..sources.tables import table as lying
from . import languages, lookalikes, markup, packing, pieces, residue, scans, tokens

#: Tables that grow, with the column by which small inputs are dealt to the cores.
GROWING = {"chunks": "chunk_key", "documents": "doc_id", "outline_nodes": "node_key"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lying(spark, sf_dir, name)
    return dealt(read, GROWING[name]) if name in GROWING else read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "profiles"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "profiles"))


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip of p2_pieces: the new parts of a chunk's pieces in order are its text."""
    part = F.struct("piece_no", F.substring("text", F.col("n_repeated") + 1, F.length("text")).alias("new"))
    parts = p2_pieces(spark, sf_dir).groupBy("chunk_key").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count("text").alias("n"))
    return parts.select("chunk_key", F.when(F.col("n") > 0, F.array_join(F.transform("parts", lambda p: p["new"]), "")).alias("text"))


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which a piece is over its profile's limit, or a piece but the first doesn't repeat its predecessor's end: none."""
    profiles = table(spark, sf_dir, "profiles").groupBy("profile").agg(F.min("chunk_max_chars").alias("most"), F.max("chunk_overlap_chars").alias("overlap"))
    limits = table(spark, sf_dir, "chunks").select("chunk_key", "profile").join(profiles, "profile")
    cut = p2_pieces(spark, sf_dir).where("n_pieces > 1").join(limits, "chunk_key")
    repeats = F.least("overlap", "char_start")
    return cut.where((F.length("text") > F.col("most")) | ((F.col("piece_no") > 1) & (F.col("n_repeated") != repeats))).select("chunk_key").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrongly_labelled(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "profiles"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.segments(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.readable_aliases(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "rules"))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent_texts(table(spark, sf_dir, "chunks"), "chunk_key", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.residue(table(spark, sf_dir, "chunks"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_reports(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "outline_nodes"))


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "outline_nodes"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: texts decoded from the ids that they were encoded to."""
    return tokens.decode_ids(p7_ids(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each container holds."""
    return p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"), (packing.CAPACITY - F.sum("n_tokens")).alias("unused"))


def p8_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's tokens lie in containers, all and once, no container is over the capacity, and only a document over it is split."""
    placed = p8_containers(spark, sf_dir)
    used = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    full = placed.join(used, "container").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_placed"), F.count("*").alias("n_parts"), F.max("used").alias("most"))
    sizes = tokens.count_tokens(table(spark, sf_dir, "documents"))
    whole = (F.coalesce("n_placed", F.lit(0)) == F.col("n_tokens")) & (F.coalesce("most", F.lit(0)) <= packing.CAPACITY) & ((F.coalesce("n_parts", F.lit(0)) <= 1) | (F.col("n_tokens") > packing.CAPACITY))
    return sizes.join(full, "doc_id", "left").select("doc_id", whole.alias("complete"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.with_residue(table(spark, sf_dir, "documents"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest as a clean corpus: documents with content and without residue."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = residue.mark_residue(documents).where(F.col("coverage") == 0).select("doc_id").distinct()
    return documents.where(F.trim("text") != "").join(marked, "doc_id", "left_semi")


def p9_parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with content, each either clean or found."""
    content = table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id")
    return p9_clean(spark, sf_dir).select("doc_id").union(p9_found(spark, sf_dir).join(content, "doc_id", "left_semi"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_rebuilt, p2_limits, p3_found, p3_segments, p4_found, p4_texts, p5_found, p5_clean, p6_found, p6_paragraphs, p7_ids, p7_decoded, p8_containers, p8_usage, p8_complete, p9_found, p9_clean, p9_parted)}

ORACLES = {
    "p4_found": lookalikes.found_sql(),
    "p4_texts": lookalikes.texts_sql(),
    "p2_found": "SELECT c.chunk_key FROM chunks c JOIN (SELECT profile, min(chunk_max_chars) AS most FROM profiles GROUP BY profile) p USING (profile) WHERE length(c.text) > p.most",
    "p2_rebuilt": "SELECT chunk_key, text FROM chunks",
    "p2_limits": "SELECT chunk_key FROM chunks WHERE false",
    "p8_complete": "SELECT doc_id, true AS complete FROM documents",
    "p9_parted": "SELECT doc_id FROM documents WHERE trim(text) <> ''",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
