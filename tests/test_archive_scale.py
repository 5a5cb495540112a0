"""What a task holds of an archive's member."""

import io
import time

from velometric.sources import archives


class Lines(io.RawIOBase):
    """A long CSV that is made as it is read."""

    def __init__(self, size):
        self.left, self.given = size, 0
        self.line = b"2024-05-01 00:00:00,2024-05-01 00:10:00,some ride\n"

    def readable(self):
        return True

    def read(self, size=-1):
        many = max(1, min(self.left, size) // len(self.line)) if self.left > 0 else 0
        self.left -= many * len(self.line)
        self.given += many * len(self.line)
        return self.line * many


def test_reader_stays_near_its_consumer():
    """However long a member is, what is read ahead of the rows that were taken stays small."""
    stream = Lines(160 << 20)
    batches = archives._csv_batches(archives._Rest(stream), ["started_at", "ended_at", "ride_id"])
    next(batches)
    time.sleep(3)
    held = stream.given
    batches.close()
    assert held < 64 << 20
