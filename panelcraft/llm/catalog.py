"""All queries of the subpackage."""

from . import (  # noqa: F401
    bpe, decontamination, exact_dedup, importance, language_id, mixing, near_dedup, quality_classifier, quality_rules, sharding, url_filters,
    warc, whitening,
)
from .registry import ORACLE, QUERIES  # noqa: F401
