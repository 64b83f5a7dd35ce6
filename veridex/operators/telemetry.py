"""One JSON line for each statement and call: what ran, how long, and which kind of error; arguments without personal data."""

from __future__ import annotations

import json
import logging
import re
import threading
import time
from collections import Counter
from collections.abc import Callable

_log = logging.getLogger("veridex")
_PRIVATE = (
    (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<email>"),
    (re.compile(r"(?i)\b(password|passwd|token|secret|api[_-]?key)\b(\s*[=:]\s*)\S+"), r"\1\2<secret>"),
    (re.compile(r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b|\b(?:\d[ -]?){13,19}\b"), "<number>"),
)


def redacted(text: str, most: int = 500) -> str:
    """text without e-mail addresses, secrets and long numbers, and no longer than a log line should be."""
    for pattern, name in _PRIVATE:
        text = pattern.sub(name, text)
    return text[:most]


def error_class(e: BaseException | None) -> str | None:
    """rejected, timeout, analysis, network or other."""
    if e is None:
        return None
    name, text = type(e).__name__, str(e).lower()
    if name == "Rejected":
        return "rejected"
    if isinstance(e, TimeoutError):
        return "timeout"
    if name == "AnalysisException" or name == "ParseException":
        return "analysis"
    return "network" if re.search(r"connection|timed out|unknownhost|slowdown|503", text) else "other"


class Telemetry:
    """Counts and tells calls. sink: takes a JSON line; the logger `veridex` by default."""

    def __init__(self, sink: Callable[[str], None] = _log.info, clock: Callable[[], float] = time.perf_counter):
        self.sink, self.clock = sink, clock
        self.counts: Counter[tuple[str, str]] = Counter()
        self.lock = threading.Lock()

    def told(self, call: str, run: Callable[[], object], **about: object):
        """run(), with a line about it."""
        began, failed = self.clock(), None
        try:
            return run()
        except BaseException as e:
            failed = e
            raise
        finally:
            kind = error_class(failed) or "ok"
            with self.lock:
                self.counts[call, kind] += 1
            line = {"call": call, "result": kind, "ms": round(1000 * (self.clock() - began))} | {k: redacted(v) if isinstance(v, str) else v for k, v in about.items()}
            self.sink(json.dumps(line, default=str))
