"""Registered queries by family; importing this package fills the registry."""

from fleetlens.plans import sources_q, rows_q, joins_q, metrics_q, sequences_q, changes_q, scalars_q, streams_q  # noqa: F401
