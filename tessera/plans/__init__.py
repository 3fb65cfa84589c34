"""All registered queries over the standard tables."""

from tessera.plans import audits, finance, functions, mail, market, mining, process, relational, restore, storage, streams, timeseries
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "finance", "functions", "mail", "market", "mining", "process", "relational", "restore", "storage", "streams", "timeseries"]
