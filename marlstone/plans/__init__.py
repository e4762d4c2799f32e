"""The registered queries over the driver's tables, with the SQL that they equal."""

from .registry import ORACLES, QUERIES, Query


def _load() -> None:
    from . import rank_queries, sampling_queries, search_queries, text_queries  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
