"""A memory of bounded size for Python workers, which live on from task to task and share an executor's memory."""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof

#: Room of a dictionary's entry beside its key and its value.
ENTRY = 100


class Remembered(dict):
    """``make(key)`` for each key, remembered in two generations of at most ``room`` / 2 bytes each.

    When the young generation is full it becomes the old one, whose place it takes; keys met again move back to the young.
    So what recurs stays, and what does not is forgotten after a while.  Values too large to keep are made anew each time.
    """

    def __init__(self, make: Callable, room: int, sizeof: Callable = getsizeof):
        super().__init__()
        self.make, self.room, self.left, self.old, self.sizeof = make, room // 2, room // 2, {}, sizeof

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = ENTRY + getsizeof(key) + self.sizeof(value)
        if size <= self.room // 16:
            self.left -= size
            if self.left < 0:
                self.old = dict(self)
                self.clear()
                self.left = self.room - size
            self[key] = value
        return value
