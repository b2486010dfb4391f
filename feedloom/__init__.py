"""Feed-digest analytics as DataFrame-to-DataFrame functions."""

from feedloom.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
