"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .operators import blocks, content, curves, design, entropy, learned, matching, merging, planes, raster, regions, reports, scalars, statistics, stencils, strings, sweep, transfer, trees  # noqa: F401
from .registered import ORACLES, QUERIES, query  # noqa: F401
from .streaming import ingest  # noqa: F401
