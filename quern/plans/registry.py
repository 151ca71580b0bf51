"""All queries and their SQL."""

from quern.plans import corpus, files, generators, knowledge, more, scoring, shaping

MODULES = [corpus, scoring, shaping, knowledge, files, more, generators]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in MODULES for k, v in m.SQL.items()}

#: Columns that DuckDB makes wider or narrower than Spark (its sums are HUGEINT, list lengths BIGINT).
_KINDS = {
    "a2_accuracy_grouping_sets": {"missing": "bigint", "correct": "bigint"},
    "a10_category_outcome_pivot": {"no_answer": "bigint", "short": "bigint", "long": "bigint"},
    "a13_copy_rate": {"exact": "bigint", "near": "bigint"},
    "w19_validation_split": {"held_out": "bigint"},
    "w10_stream_windows": {"ids": "int[]"},
    "w11_padded_windows": {"ids": "int[]"},
    "w13_shifted_targets": {"tgt": "int[]"},
    "pred14_fits_window": {"fits": "bigint"},
    "a21_window_counts": {"unpadded": "bigint", "padded": "bigint"},
    "a12_flag_sums": {"no_prompt": "bigint", "no_answer": "bigint", "no_tier": "bigint", "with_context": "bigint"},
    "m5_hashed_features": {"dim": "bigint", "v": "bigint"},
    "k2_shards": {"shard": "bigint"},
    "late_loads": {"late": "bigint", "never": "bigint"},
}
for _name, _cols in _KINDS.items():
    SQL[_name] = f"select * replace ({', '.join(f'cast({c} as {k}) as {c}' for c, k in _cols.items())}) from ({SQL[_name]}) q"
