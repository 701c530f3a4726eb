"""Imports every operator module, which registers its query."""

from . import alignment, decontamination, filter_audit, fingerprints, jaccard, licenses, mixing, packing, secrets, suffixes, token_counts, toxicity, urls  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
