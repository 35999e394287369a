"""Registered queries and the SQL that states what each must return."""

from __future__ import annotations

from loomspan.plans import editing, ranking, streams, texts

QUERIES = ranking.QUERIES | texts.QUERIES | streams.QUERIES | editing.QUERIES
#: None for stream_captions: its test compares it with plain code.
ORACLE_SQL = ranking.ORACLE_SQL | texts.ORACLE_SQL | streams.ORACLE_SQL | editing.ORACLE_SQL
