"""The registered pipeline query."""

from __future__ import annotations

import corpus_pipeline

QUERIES = {"pipeline": corpus_pipeline.run}
SQL = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
