"""Rollout, reward and evaluation analytics as Spark jobs."""

from runlens.session import build_session, work_path

__all__ = ["build_session", "work_path"]
