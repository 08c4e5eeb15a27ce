"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, extraction, jaccard, lines, packing, phrases, quality, sharding, suffixes, suffixtree


def queries() -> dict:
    out = {}
    for module in (sharding, packing, quality, jaccard, lines, decontaminate, suffixtree, phrases, suffixes, extraction):
        out |= {k: f for k, f in vars(module).items() if k.startswith("op") and k[2].isdigit()}
    return out


def oracle_sql() -> dict[str, str]:
    return {"op7_phrase_automata": phrases.OP7_SQL, "op6_positional_index": decontaminate.OP6_SQL, "op5_jaccard_divideskip": jaccard.OP5_SQL}
