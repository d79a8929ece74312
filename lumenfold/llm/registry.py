"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from . import decontaminate, licenses, packing, parsing, quality, secrets, sharding, simhash, toxicity, urls


def queries():
    return {
        "op1_simhash_near_dedup": simhash.op1,
        "op2_stratified_sharding": sharding.op2,
        "op3_toxicity_mil": toxicity.op3,
        "op4_quality_knn": quality.op4,
        "op5_secret_scan": secrets.op5,
        "op6_document_fingerprints": parsing.op6,
        "op7_url_filter": urls.op7,
        "op8_license_scan": licenses.op8,
        "op9_benchmark_decontamination": decontaminate.op9,
        "op10_best_fit_packing": packing.op10,
    }


def oracle_sql():
    return {
        "op2_stratified_sharding": sharding.oracle(),
        "op7_url_filter": urls.oracle(),
        "op8_license_scan": licenses.oracle(),
    }
