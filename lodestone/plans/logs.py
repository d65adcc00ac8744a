"""Log sink: a file of bounded size at the settings' level; warnings and errors on the console too."""

from __future__ import annotations

import logging
import os
from logging.handlers import RotatingFileHandler

from lodestone.plans.config import Settings

# Size of a log file and how many old ones stay.
FILE_BYTES, OLD_FILES = 5 * 1024 * 1024, 3

log = logging.getLogger("lodestone")


def start(s: Settings) -> logging.Logger:
    """Send the library's log to log_dir/log_file. A second call replaces the sinks of the first."""
    os.makedirs(s.log_dir, exist_ok=True)
    sinks = [(RotatingFileHandler(os.path.join(s.log_dir, s.log_file), maxBytes=FILE_BYTES, backupCount=OLD_FILES, encoding="utf-8"), s.log_level.upper(), "%(asctime)s %(levelname)s %(name)s %(message)s"), (logging.StreamHandler(), "WARNING", "%(levelname)s: %(message)s")]
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for sink, level, form in sinks:
        sink.setLevel(level)
        sink.setFormatter(logging.Formatter(form))
        log.addHandler(sink)
    log.setLevel(s.log_level.upper())
    log.propagate = False
    return log
