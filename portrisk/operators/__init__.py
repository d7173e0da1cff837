"""DataFrame -> DataFrame operators: ingestion, latest state, as-of join, contingency scoring, reports, model."""
