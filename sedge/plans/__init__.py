"""Ready-made queries over the given tables, each with the SQL that must give the same rows."""

from sedge.plans import documents, files, learning, literature, portfolios, sensor, streams
from sedge.plans.registry import Registry

ALL = Registry()
for part in (literature, sensor, documents, portfolios, learning, files, streams):
    ALL.merge(part.registry)
