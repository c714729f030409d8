"""All registered repertoire queries."""

from __future__ import annotations

from sparktoire.plans import evaluation, frequencies, ingest, modelling, similarity  # noqa: F401  (they register their queries)
from sparktoire.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "a05_vj_frequencies"
