"""The queries of the training-data operators, their SQL where SQL can express them, and the pipeline."""

from __future__ import annotations

from importlib import import_module

#: query: module of this subpackage that has it
WHERE = {
    "op1_quality_rules": "line_rules",
    "op2_quality_fm": "quality_fm",
    "op9_toxicity_cf": "toxicity_cf",
    "op3_column_bwt": "column_bwt",
    "op4_token_stream": "token_stream",
    "op5_fair_mix": "fair_mix",
    "op6_line_dedup": "line_dedup",
    "op7_best_fit": "best_fit",
    "op8_hilbert_ann": "hilbert_ann",
    "op10_simhash_vptree": "simhash_vptree",
    "op11_improbable_digest": "improbable_digest",
    "op12_interval_sweep": "interval_sweep",
    "op13_radix_audit": "radix_audit",
}
#: those whose rows SQL can express, as the module's constant OPn_SQL
SQL = ("op1_quality_rules", "op5_fair_mix", "op12_interval_sweep", "op13_radix_audit")


def queries() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in WHERE.items()}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{WHERE[name]}"), f"{name.split('_')[0].upper()}_SQL") for name in SQL}
