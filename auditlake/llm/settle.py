"""Written intermediate tables whose shuffle files go when the write has ended."""

from __future__ import annotations

from auditlake.session import settled, shuffles_dropped

__all__ = ["settled", "shuffles_dropped"]
