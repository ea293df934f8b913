"""Queries of this subpackage, by the names that they are registered under."""

from __future__ import annotations

from . import bpe, exact_dedup, language, neighbours, packing, quality, sanitise, secrets, simhash, sstable

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_token_shards": sstable.query,
    "op3_language_id": language.query,
    "op4_collision_neighbours": neighbours.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_best_fit_packing": packing.query,
    "op7_quality_rules": quality.query,
    "op8_pii_sanitise": sanitise.query,
    "op9_secret_scan": secrets.query,
    "op10_byte_bpe": bpe.query,
}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.ORACLE}
