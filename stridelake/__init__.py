"""Rolling-window allocation studies, block bootstraps and corpus operators as Spark plans."""

from __future__ import annotations

__version__ = "0.1.0"
