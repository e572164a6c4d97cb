"""A memo that workers keep between batches, bounded in bytes."""

from __future__ import annotations

ENTRY = 200  # about what an entry takes beside its texts


class Memo:
    """What was asked for lately: two generations of about `most` bytes each; what the older one answers moves to the younger. A batch's own
    entries are all held until the next one, whatever they take."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def begin(self) -> None:
        """Before a batch: the younger generation grows old if it is full."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young if self.size <= 2 * self.most else {}, {}, 0

    def missing(self, keys) -> list:
        """The keys without an entry; the others are in `young` from now on, until the next batch."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    self.put(k, v)
        return out

    def put(self, key, value) -> None:
        self.young[key] = value
        self.size += len(key) + sum(len(v) for v in value if isinstance(v, str)) + ENTRY
