"""All queries of the engine's own operators."""

from effortlens.plans import features, identities, labels, listings, measures, orderings, patterns, reports, streams, wallets

_ALL = listings.QUERIES | measures.QUERIES | features.QUERIES | reports.QUERIES | streams.QUERIES | patterns.QUERIES | wallets.QUERIES | identities.QUERIES | labels.QUERIES | orderings.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
