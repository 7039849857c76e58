"""The queries of this subpackage: importing their modules registers them."""

from __future__ import annotations

from dossier.llm import (  # noqa: F401
    ann, decontaminate, langid, lattice, licenses, merkle, ngram_join, packing, pii, quality, resampling, templates, warc,
)
from dossier.llm.base import ORACLES, QUERIES  # noqa: F401
