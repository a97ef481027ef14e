"""An event query engine on PySpark: filters, substring search, visibility, storage and live subscriptions."""

from tidelog.operators.purge import PurgePolicy, PurgeSpecError
from tidelog.plans.filters import Filter, FilterError, parse_filters
from tidelog.sources.store import Store, StoreOptions

__all__ = ["Filter", "FilterError", "PurgePolicy", "PurgeSpecError", "Store", "StoreOptions", "parse_filters"]
