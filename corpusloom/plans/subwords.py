"""Named queries over sub-word pieces.  Any vocabulary file serves; these
take the pieces of a public one, cut by longest match."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import subwords as SW
from corpusloom.plans.common import T
from corpusloom.sources import derived

#: Ids of its special tokens; there is no unknown piece, so the last one stands for it.
FIRST, LAST = 49406, 49407


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _public(spark) -> SW.Subwords:
    return SW.Subwords.from_json(spark, vocabulary_path(), LAST, word_end="</w>", byte_level=True)


def subword_counts(spark, sf_dir):
    """K-01: pieces of every document with two special tokens, those that no
    piece covers, and the characters under its longest piece."""
    p = T(spark, sf_dir, "documents").select("doc_id", _public(spark).pieces("text").alias("p"))
    return p.select("doc_id", (F.size("p") + 2).cast("bigint").alias("total_tokens"),
                    F.size(F.filter("p", lambda x: x["id"] == LAST)).alias("n_unknown"),
                    F.coalesce(F.array_max(F.transform("p", lambda x: x["end"] - x["start"])), F.lit(0)).alias("longest"))


def subword_pad(spark, sf_dir):
    """K-06: ids of sequences of 512 between their special ids, padded."""
    r = SW.pad_truncate_subwords(T(spark, sf_dir, "documents"), _public(spark), "doc_id", "text", 512, 0, FIRST, LAST)
    return r.select("doc_id", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ")).alias("ids_md5"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"), "n_chars_covered")


def subword_alignment(spark, sf_dir):
    """K-07: IN-7 word tags on the first pieces of their words, sequences of 512."""
    w = derived.word_tag_rows(T(spark, sf_dir, "documents"))
    r = SW.align_labels_subwords(w, _public(spark), "doc_id", "pos", "word", "tag_id", 512)
    return r.select("doc_id", "part", F.size("input_ids").alias("n_pieces"),
                    F.size(F.filter("labels", lambda x: x != -100)).alias("n_labelled"),
                    F.md5(F.array_join(F.col("labels").cast("array<string>"), " ")).alias("labels_md5"))
