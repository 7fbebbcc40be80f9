"""The registered queries over the reference tables; importing this package fills the registry."""

from tallyloom.plans import accounts, aggregates, cells, channels, features, filters, joins, ordered, records, repairs, reports, scalars, streamed, surface
from tallyloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "accounts", "aggregates", "cells", "channels", "features", "filters", "joins", "ordered", "records", "repairs", "reports", "scalars", "streamed", "surface"]
