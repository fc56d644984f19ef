"""Point-in-time analytics on Spark: as-of reads, holdings, splits, temporal graph events, rules.

Names are imported when they are first asked for, so that a Python worker that
needs one module doesn't load all.
"""

from importlib import import_module

_MODULES = {
    "errors": ["DataConflictError"],
    "operators.asof": ["get_asset_snapshot_asof", "get_customer_snapshot_asof", "get_prices_asof"],
    "operators.encoding": ["IDMapping", "build_id_mapping", "encode_transactions", "fit_id_mapping"],
    "operators.graph": ["TemporalGraphEvents", "build_interaction_snapshot", "build_temporal_graph_events", "iter_event_windows"],
    "operators.holdings": ["PointInTimeState", "build_holdings_asof", "build_point_in_time_state", "currently_held_assets", "get_candidate_assets"],
    "operators.rules": ["validate_dataset", "validate_primary_split", "validate_rolling_split"],
    "operators.splits": ["PrimarySplit", "RollingSplit", "build_primary_split", "build_rolling_splits"],
    "sources.catalog": ["TableCatalog"],
}
_WHERE = {name: module for module, names in _MODULES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
