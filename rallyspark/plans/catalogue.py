"""All registered queries: each takes (spark, sf_dir) and returns a DataFrame; ``ORACLES`` has the same result in DuckDB SQL."""

from __future__ import annotations

from rallyspark.plans import domain, feeds, folds, imports, jobs, joins, live, people, reads, replays, review, rounds, running, stages, texts

_REGISTRIES = [joins.registry, folds.registry, live.registry, domain.registry, texts.registry, jobs.registry, review.registry, replays.registry, running.registry, rounds.registry, people.registry, stages.registry, feeds.registry, reads.registry, imports.registry]
assert len({n for r in _REGISTRIES for n in r.queries}) == sum(len(r.queries) for r in _REGISTRIES), "two queries of one name"
QUERIES = {name: f for r in _REGISTRIES for name, f in r.queries.items()}
ORACLES = {name: sql for r in _REGISTRIES for name, sql in r.oracles.items()}
