"""A bounded memo that keeps what is asked for often."""

from __future__ import annotations

from typing import Any

GENERATION = 250_000
LONGEST_KEY = 64


class Memo:
    """Two generations of a dict. A full young one becomes the old one; what is asked for again moves back.

    Hot loops ask ``young.get``; on a miss, ask ``old`` and then ``put`` the value. Keys over ``LONGEST_KEY`` characters are not kept.
    """

    def __init__(self, generation: int = GENERATION):
        self.generation = generation
        self.young: dict[str, Any] = {}
        self._old: dict[str, Any] = {}

    def old(self, key: str) -> Any:
        return self._old.get(key)

    def put(self, key: str, value: Any) -> Any:
        if len(key) <= LONGEST_KEY:
            if len(self.young) >= self.generation:
                self._old = dict(self.young)
                self.young.clear()
            self.young[key] = value
        return value
