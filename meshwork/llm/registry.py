"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embedding_dedup, fingerprints, licenses, line_dedup, minhash, packing, pieces, quality, sharding, warc_store

QUERIES = {
    f.__name__: f
    for f in (
        embedding_dedup.op1_itq_embedding_dedup,
        packing.op2_harmonic_packing,
        quality.op3_attention_quality,
        warc_store.op4_content_addressed_warc,
        pieces.op5_offset_preserving_pieces,
        minhash.op6_minhash_near_dedup,
        licenses.op7_license_scan,
        sharding.op8_feistel_sharding,
        fingerprints.op9_piecewise_fingerprints,
        line_dedup.op10_line_dedup,
    )
}
ORACLE_SQL = {
    "op1_itq_embedding_dedup": embedding_dedup.OP1_SQL,
    "op4_content_addressed_warc": warc_store.OP4_SQL,
    "op6_minhash_near_dedup": minhash.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op8_feistel_sharding": sharding.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
