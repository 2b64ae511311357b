"""Keyed rows that wait in state until the watermark is past them, in slots of event time."""
from collections.abc import Iterator

WIDTH = 60_000_000      # microseconds


class Slots:
    """Rows of a key by slot of time: a row is written once and read only when its slot is asked for.

    Two map states: how many rows a slot has, and the rows by (slot, number). Nothing is ever read back whole.
    """

    def __init__(self, handle, name: str, row: str):
        self.handle = handle
        self.counts = handle.getMapState(f"{name}_counts", "slot bigint", "n int")
        self.rows = handle.getMapState(f"{name}_rows", "slot bigint, number int", row)

    def add(self, slot: int, rows: list[tuple], due: int) -> None:
        """Keeps rows of a slot; a timer fires when the watermark reaches `due` microseconds."""
        found = self.counts.getValue((slot,))
        n = found[0] if found else 0
        for i, row in enumerate(rows):
            self.rows.updateValue((slot, n + i), row)
        self.counts.updateValue((slot,), (n + len(rows),))
        self.handle.registerTimer(due // 1000)

    def read(self, slot: int) -> Iterator[tuple]:
        found = self.counts.getValue((slot,))
        for number in range(found[0] if found else 0):
            yield self.rows.getValue((slot, number))

    def drop(self, slot: int) -> None:
        found = self.counts.getValue((slot,))
        for number in range(found[0] if found else 0):
            self.rows.removeKey((slot, number))
        if found:
            self.counts.removeKey((slot,))
