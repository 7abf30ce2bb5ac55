"""The queries of this package and their DuckDB SQL, for the driver's catalogue."""

from __future__ import annotations

from tallsketch.llm import (bpe, embedding_join, exact_dedup, licenses, minhash_dedup, packing, secret_scan, sharding, spelling,
                            suffix_dedup, toxicity, warc, whitening)

MODULES = (licenses, sharding, minhash_dedup, warc, exact_dedup, embedding_join, toxicity, bpe, suffix_dedup, packing,
           secret_scan, whitening, spelling)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
