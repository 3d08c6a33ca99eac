"""The queries over the driver's tables and the SQL that expresses them."""


def registered() -> tuple[dict, dict]:
    """All queries and their SQL; the modules register on import."""
    from . import languages, queries, scalars, services  # noqa: F401

    return queries.QUERIES, queries.ORACLES
