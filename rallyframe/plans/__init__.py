"""Named queries with their SQL, and whole runs."""

from rallyframe.plans import general, reference, features, parts  # noqa: F401  (in this order: later modules add to the queries)
