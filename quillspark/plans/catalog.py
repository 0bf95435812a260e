"""All queries of the record engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from quillspark.plans import analysis, answers, archive, documents, filings, minutes, names, pairs, records, records_sql, search, voices, wording

QUERIES: dict = records.QUERIES | documents.QUERIES | archive.QUERIES | analysis.QUERIES | search.QUERIES | pairs.QUERIES | voices.QUERIES | wording.QUERIES | minutes.QUERIES | names.QUERIES | filings.QUERIES | answers.QUERIES
ORACLES: dict[str, str] = records_sql.ORACLES | documents.ORACLES | archive.ORACLES | analysis.ORACLES | search.ORACLES | pairs.ORACLES | voices.ORACLES | wording.ORACLES | minutes.ORACLES | names.ORACLES | filings.ORACLES | answers.ORACLES
