"""When a failed stream is started again."""

from __future__ import annotations

import random
import re
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

#: Names of exceptions that another attempt does not mend.
PERMANENT = ("ConfigError", "SqlError", "LexError", "UnexpectedToken", "ExpectedToken", "UnknownColumn", "UnsupportedFeature", "AnalysisException", "ParseException", "PermissionError")


def permanent(error: BaseException) -> bool:
    """Whether the error, its cause, or what a stream's own exception tells of, is one of those."""
    names = {c.__name__ for c in type(error).__mro__}
    if "StreamingQueryException" in names:
        names |= set(re.findall(r"\b[A-Z]\w+\b", str(error)))
    return bool(names & set(PERMANENT)) or (error.__cause__ is not None and permanent(error.__cause__))


@dataclass
class RestartPolicy:
    """Backoff with full jitter, and a hold after too many failures in a while."""

    least: float = 0.5
    most: float = 30.0
    factor: float = 1.8
    budget: int = 8
    within: float = 60.0
    hold: float = 60.0
    jitter: Callable[[], float] = random.random
    failures: deque = field(default_factory=deque)
    streak: int = 0

    def delay(self, now: float) -> float:
        """Seconds to wait after a failure at ``now``."""
        self.failures.append(now)
        while self.failures and now - self.failures[0] > self.within:
            self.failures.popleft()
        self.streak += 1
        if len(self.failures) >= self.budget:
            self.failures.clear()
            self.streak = 0
            return self.hold
        ceiling = min(self.most, self.least * self.factor ** (self.streak - 1))
        return max(self.least, ceiling * self.jitter()) if self.streak > 1 else self.least

    def succeeded(self) -> None:
        self.streak = 0


def supervise(run: Callable[[], None], policy: RestartPolicy | None = None, clock=time.monotonic, sleep=time.sleep, stop: Callable[[], bool] = lambda: False) -> None:
    """Call ``run`` until it ends by itself; a permanent error is raised."""
    policy = policy or RestartPolicy()
    while not stop():
        try:
            run()
            return
        except Exception as e:
            if permanent(e):
                raise
            sleep(policy.delay(clock()))
