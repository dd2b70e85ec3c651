"""Parameters of a count."""

from __future__ import annotations

from dataclasses import dataclass

COUNT_LIMIT = 2**32 - 1  # counts saturate here


@dataclass(frozen=True)
class CountParams:
    """k: window length.  A k-mer is kept if filter_min <= count <= filter_max, and its
    count is then cut to count_max.  Values are plain integers from 1 to 2**32 - 1.
    A filter_min above filter_max keeps nothing."""

    k: int
    filter_min: int = 2
    filter_max: int = COUNT_LIMIT
    count_max: int = 255
    piece_len: int = 1000

    def __post_init__(self) -> None:
        for name in ("k", "filter_min", "filter_max", "count_max", "piece_len"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be an integer of 1 or more, not {value!r}")
            if value > COUNT_LIMIT:
                raise ValueError(f"{name} must be at most {COUNT_LIMIT}")

    @property
    def count_bytes(self) -> int:
        """Width of a count in the binary format."""
        return 1 if self.count_max <= 0xFF else 2 if self.count_max <= 0xFFFF else 4

    @property
    def kmer_bytes(self) -> int:
        return -(-self.k // 4)
