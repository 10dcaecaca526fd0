"""Named queries over the test tables, with their SQL."""


def load() -> None:
    """Registers every query."""
    from . import q_engines, q_eval, q_index, q_more  # noqa: F401
