"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers

from . import addquant, idfile, langid, linededup, nearvec, packing, phrases, pieces, pii, setjoin, toxicity, warc, whitening
from .common import Scratch

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, 1024, 2)


def op2_warc_derivatives(spark, sf_dir):
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op3_line_chunk_dedup(spark, sf_dir):
    return linededup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_max_plus_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


def op4_ranked_id_file(spark, sf_dir):
    path = Scratch(spark, "idfile").base
    idfile.write(table(spark, sf_dir, "documents"), path, BYTE_BPE, 0)
    return idfile.read(spark, path)


def op5_hierarchical_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_semi_markov_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op6_additive_quantisation(spark, sf_dir):
    return addquant.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0", "vec_id", "embedding", 20)


def op8_rotation_code_dedup(spark, sf_dir):
    return nearvec.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.93)


def op7_ngram_jaccard_join(spark, sf_dir):
    return setjoin.link_components(table(spark, sf_dir, "documents"), 4, 85)


def op11_incremental_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_best_first_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_ratio_scaled_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_warc_derivatives,
        op3_line_chunk_dedup,
        op4_ranked_id_file,
        op5_hierarchical_language_id,
        op6_additive_quantisation,
        op7_ngram_jaccard_join,
        op8_rotation_code_dedup,
        op9_max_plus_pieces,
        op10_semi_markov_pii,
        op11_incremental_whitening,
        op12_best_first_phrases,
        op13_ratio_scaled_toxicity,
    )
}
ORACLE = {"op3_line_chunk_dedup": linededup.ORACLE, "op12_best_first_phrases": phrases.ORACLE}
