"""Progress messages on the logger "kindred", which a program shows or leaves out by its level."""

from __future__ import annotations

import logging
import time

LOGGER = logging.getLogger("kindred")


def show_progress(level: int = logging.INFO) -> logging.Handler:
    """Write messages of that level and above to the standard error, each with the time (UTC)."""
    handler, layout = logging.StreamHandler(), logging.Formatter("%(asctime)s kindred: %(message)s")
    layout.converter = time.gmtime
    handler.setFormatter(layout)
    LOGGER.addHandler(handler)
    LOGGER.setLevel(level)
    return handler


def progress(text: str, *values: object) -> None:
    LOGGER.info(text, *values)
