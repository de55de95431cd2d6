"""All wayfinding queries and their SQL, in the order in which their modules register them."""

from waymark.plans import guidance, motion, outside, paths, places, routes, tracking, verdicts
from waymark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "guidance", "motion", "outside", "paths", "places", "routes", "tracking", "verdicts"]
