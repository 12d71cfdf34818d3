"""Input views over the supplied tables, registered queries and their SQL."""

from auditlake.plans.registry import ORACLES, QUERIES


def load_all() -> tuple[dict, dict[str, str]]:
    """Imports every module of queries; returns the queries and their SQL."""
    from auditlake.plans import modules

    modules.load()
    return dict(QUERIES), dict(ORACLES)
