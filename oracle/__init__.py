"""Oracle SQL for every query that ANSI SQL can express, ready to run."""

from . import evidence, field_scores, live_events, live_tables, loading, race, task_match
from .ctes import compose

ORACLES = {name: compose(sql) for name, sql in {**race.SQL, **field_scores.SQL, **live_tables.SQL, **task_match.SQL, **evidence.SQL, **loading.SQL, **live_events.SQL}.items()}
