"""rosterflow: operational event analytics as PySpark DataFrame operators."""

from rosterflow.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
