"""Cron expressions, and one run at a time."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

#: Presets of refresh times (fixed values).
PRESETS = {"hourly": "0 * * * *", "daily": "0 9 * * *", "weekly": "0 9 * * 1"}
NAMES = {n: k for k, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {n: k for k, n in enumerate("sun mon tue wed thu fri sat".split())}
BOUNDS = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]


class CronError(ValueError):
    pass


def _values(text: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        try:
            if span == "*":
                a, b = low, high
            else:
                a, _, b = span.partition("-")
                a = NAMES.get(a) if a in NAMES else int(a)
                b = (NAMES.get(b) if b in NAMES else int(b)) if b else (high if step else a)
            every = int(step) if step else 1
        except ValueError as e:
            raise CronError(f"can't read {part!r}") from e
        if not low <= a <= b <= high or every < 1:
            raise CronError(f"{part!r} is out of range")
        out.update(range(a, b + 1, every))
    return frozenset(out)


class Cron:
    """Five fields, or six with seconds first; or the name of a preset."""

    def __init__(self, text: str):
        parts = PRESETS.get(text, text).split()
        if len(parts) not in (5, 6):
            raise CronError(f"not a cron expression: {text!r}")
        parts = ["0", *parts] if len(parts) == 5 else parts
        self.fields = [_values(p, *b) for p, b in zip(parts, BOUNDS)]
        self.fields[5] = frozenset(v % 7 for v in self.fields[5])
        self.any_day, self.any_weekday = parts[3] == "*", parts[5] == "*"

    def matches(self, at: datetime) -> bool:
        s, m, h, day, month, weekday = self.fields
        on_day, on_weekday = at.day in day, (at.weekday() + 1) % 7 in weekday
        days = on_day and on_weekday if self.any_day or self.any_weekday else on_day or on_weekday
        return days and at.second in s and at.minute in m and at.hour in h and at.month in month

    def after(self, at: datetime) -> datetime:
        """The next time after ``at``."""
        second = min(self.fields[0])
        now = at.replace(second=0, microsecond=0)
        for s in sorted(self.fields[0]):
            if now.replace(second=s) > at and self.matches(now.replace(second=s)):
                return now.replace(second=s)
        for _ in range(4 * 366 * 24 * 60):
            now += timedelta(minutes=1)
            if now.hour not in self.fields[2]:
                now = now.replace(minute=59)
                continue
            if self.matches(now.replace(second=second)):
                return now.replace(second=second)
        raise CronError("never")


def valid(text: str) -> bool:
    try:
        Cron(text)
        return True
    except CronError:
        return False


class Lock:
    """A lock file that names its process; one of a process that ended is stale."""

    def __init__(self, path: str):
        self.path = path

    def acquire(self) -> bool:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        for _ in range(2):
            try:
                f = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if not self._stale():
                    return False
                os.unlink(self.path)
                continue
            os.write(f, str(os.getpid()).encode())
            os.close(f)
            return True
        return False

    def _stale(self) -> bool:
        try:
            pid = int(open(self.path).read() or 0)
            os.kill(pid, 0)
            return False
        except (ValueError, ProcessLookupError):
            return True
        except OSError:
            return False

    def release(self) -> None:
        if os.path.exists(self.path):
            os.unlink(self.path)

    def __enter__(self):
        if not self.acquire():
            raise RuntimeError(f"{self.path} is held by another run")
        return self

    def __exit__(self, *_):
        self.release()
