"""All check SQL by query name."""
import re

from oracle import asset_sql, flow_sql, raster_sql, region_sql


def as_doubles(sql: str) -> str:
    """Write decimal literals outside quotes as doubles, the type Spark computes with."""
    parts = sql.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in parts[::2]]
    return "'".join(parts)


SQL = {name: as_doubles(text) for name, text in {**asset_sql.SQL, **raster_sql.SQL, **region_sql.SQL, **flow_sql.SQL}.items()}
