"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

from pulsewright.llm import bpe, classifier, codes, linededup, lm, media, minhash, packing, pii, quality, simhash, urls, whitening
from pulsewright.llm.common import table


def op9_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicate_digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs, removed="units_removed").select("doc_id", "text", "units_removed")


def op6_media_columns(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_suffix_tree_scores(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classifier.classify(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op4_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op12_contour_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_cover_tree_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op11_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op11_minhash_near_dedup": op11_minhash_near_dedup, "op12_contour_whitening": op12_contour_whitening, "op13_cover_tree_codes": op13_cover_tree_codes, "op4_pii": op4_pii, "op8_quality_classifier": op8_quality_classifier, "op7_suffix_tree_scores": op7_suffix_tree_scores, "op6_media_columns": op6_media_columns, "op10_line_dedup": op10_line_dedup, "op5_quality_rules": op5_quality_rules, "op1_simhash_near_dedup": op1_simhash_near_dedup, "op3_best_fit_packing": op3_best_fit_packing, "op2_byte_bpe": op2_byte_bpe, "op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": urls.oracle()}
