"""STR11, A17: token buckets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class TokenBucket:
    """``limit`` requests a minute; a bucket starts full."""

    limit: int
    tokens: float = -1.0
    last: float = 0.0

    def allow(self, now: float) -> bool:
        if self.tokens < 0:
            self.tokens, self.last = float(self.limit), now
        self.tokens = min(float(self.limit), self.tokens + max(0.0, now - self.last) * self.limit / 60)
        self.last = max(self.last, now)
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False
