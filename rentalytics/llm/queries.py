"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from rentalytics.llm import (
    classifier, divergence, fingerprints, jaccard_join, licenses, mixing, packing, quality_rules, secrets, sharding,
    training_order, urls, variants,
)

QUERIES = {
    "op1_mix": mixing.query,
    "op2_shards": sharding.query,
    "op3_quality_rules": quality_rules.query,
    "op4_classifier": classifier.query,
    "op5_secrets": secrets.query,
    "op6_pack": packing.query,
    "op7_fingerprints": fingerprints.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_training_order": training_order.query,
    "op10_url_rules": urls.query,
    "op11_licenses": licenses.query,
    "op12_variants": variants.query,
    "op13_divergence": divergence.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op10_url_rules": urls.SQL, "op13_divergence": divergence.SQL}
