"""The queries of this subpackage by name: (callable, SQL or None)."""

from __future__ import annotations

from lexloom.llm import (
    collocations, decontamination, lattice_lm, license_scan, mixing, oracles, periodic_runs, pii, quality_cnn, quality_rules, simhash_dedup,
    substring_dedup, suffix_dedup, vector_tree,
)
from lexloom.llm.common import table


def _docs(operator, *others):
    def query(spark, sf_dir):
        return operator(*(table(spark, sf_dir, name) for name in ("documents", *others)))

    return query


Q = {
    "op1_pii": (_docs(pii.op1), None),
    "op2_source_mixing": (_docs(mixing.op2), None),
    "op3_suffix_dedup": (_docs(suffix_dedup.op3), oracles.suffix_dedup()),
    "op4_quality_rules": (_docs(quality_rules.op4), None),
    "op5_substring_dedup": (_docs(substring_dedup.op5), oracles.substring_dedup()),
    "op6_license_scan": (_docs(license_scan.op6), license_scan.oracle()),
    "op7_benchmark_decontamination": (_docs(decontamination.op7, "benchmark"), None),
    "op8_lattice_lm": (_docs(lattice_lm.op8), None),
    "op9_simhash_dedup": (_docs(simhash_dedup.op9), None),
    "op10_quality_classifier": (_docs(quality_cnn.op10, "labels"), None),
    "op11_periodic_runs": (_docs(periodic_runs.op11), oracles.periodic_runs()),
    "op12_nearest_neighbours": (lambda spark, sf_dir: vector_tree.op12(table(spark, sf_dir, "embeddings")), None),
    "op13_phrase_collocations": (_docs(collocations.op13), collocations.oracle()),
}
