"""Every query by name."""

from . import evidence, field_scores, live_events, live_tables, loading, race, task_match

QUERIES = {**race.QUERIES, **field_scores.QUERIES, **live_tables.QUERIES, **task_match.QUERIES, **evidence.QUERIES, **loading.QUERIES, **live_events.QUERIES}
