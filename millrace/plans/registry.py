"""Every registered query and its SQL."""

from . import classification, decisions, entities, guards, keys_and_checks, resampling, sampling, streams, studies, trees

_ALL = [keys_and_checks, sampling, studies, classification, entities, guards, resampling, trees, decisions, streams]

QUERIES = {name: query for module in _ALL for name, (query, _) in module.QUERIES.items()}
ORACLES = {name: sql for module in _ALL for name, (_, sql) in module.QUERIES.items() if sql}
