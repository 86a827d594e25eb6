"""Detection, reversible masking and measurement of personal data in large text collections, on Spark."""

from __future__ import annotations

import importlib

_EXPORTS = {
    "Detector": "plans.detector", "PrecomputedSpans": "plans.detector", "TokenProbabilities": "plans.detector",
    "Rule": "operators.rules", "DEFAULT_RULES": "operators.rules", "Calibrator": "operators.calibrate",
    "with_mask": "operators.mask", "unmasked": "operators.mask", "round_trip": "operators.egress", "EgressViolation": "operators.egress",
    "detection_rates": "operators.match", "recall_at_fixed_fpr": "operators.match", "normalize": "functions.text",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
    raise AttributeError(name)
