"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import collocations, embedding_dedup, language_id, line_dedup, merkle, mixing, near_dedup, quality, secrets, sentencepiece_codec, token_files, url_filter, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_warc": warc.op3_warc,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_language_id": language_id.op8_language_id,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_token_files": token_files.op11_token_files,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op9_embedding_dedup": embedding_dedup.OP9_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
