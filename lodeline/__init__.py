"""Spark-native operators for analytics and machine-learning data work."""

from lodeline.session import get_session, max_group_rows, work_dir

__all__ = ["get_session", "max_group_rows", "work_dir"]
