"""Spark-native archives of exported chat conversations."""

from threadlake.session import build_session, materialize
from threadlake.plans.archive import Archive, build_archive

__all__ = ["Archive", "build_archive", "build_session", "materialize"]
