"""tuneprep: fine-tuning-data preparation and analytics as Spark DataFrame jobs."""

from tuneprep.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
