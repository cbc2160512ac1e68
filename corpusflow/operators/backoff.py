"""M3 with a memory: one controller for all calls of a task, in place of waits that know nothing of each other.

The number of calls at once rises by one per round of good answers (additive increase) and is halved when the service refuses one for its
rate (multiplicative decrease), once per burst of refusals.  A refused call waits its turn and is asked again; the waiting time doubles while
refusals go on.
"""

from __future__ import annotations

import threading
import time
from typing import Callable

#: How often a call may be refused for the service's rate before it fails.
REFUSALS = 30
#: First wait after a refusal, and the longest, in seconds.
FIRST_WAIT, LONGEST_WAIT = 0.5, 30.0


class Controller:
    """Lets at most ``limit`` calls run; ``limit`` follows the service."""

    def __init__(self, most: int, sleep: Callable[[float], None] = time.sleep):
        self.most, self.limit, self.running, self.burst, self.refusals = max(1, most), float(max(1, most)), 0, 0, 0
        self.sleep, self.turn = sleep, threading.Condition()

    def __enter__(self) -> int:
        """Waits for a place; returns the burst in which the call began."""
        with self.turn:
            self.turn.wait_for(lambda: self.running < max(1, int(self.limit)))
            self.running += 1
            return self.burst

    def __exit__(self, *error) -> None:
        with self.turn:
            self.running -= 1
            self.turn.notify_all()

    def answered(self) -> None:
        with self.turn:
            self.limit, self.refusals = min(self.most, self.limit + 1 / self.limit), 0
            self.turn.notify_all()

    def refused(self, burst: int) -> None:
        """Halves the limit, unless another call of the same burst did, and waits."""
        with self.turn:
            if burst == self.burst:
                self.burst += 1
                self.limit = max(1.0, self.limit / 2)
            self.refusals += 1
            wait = min(LONGEST_WAIT, FIRST_WAIT * 2 ** min(self.refusals, 10))
        self.sleep(wait)
