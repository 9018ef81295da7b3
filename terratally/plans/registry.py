"""All registered queries by name."""
from terratally.plans import asset_queries, flow_queries, raster_queries

QUERIES = {**asset_queries.QUERIES, **raster_queries.QUERIES, **flow_queries.QUERIES}
