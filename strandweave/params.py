"""Parameters of sampling and of the dictionary."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

#: Fixed value: the odd-looking multiplier that belongs to seed 7; a dictionary is only comparable with one made with the same.
FACTOR_SEED_7 = 4490898023665754691


@dataclass(frozen=True)
class SampleParams:
    """k bases of a k-mer, w k-mers of a window's reach, and the hash's multiplier.

    A sampled fragment has ``length`` = w + k bases, an odd number, so that none is
    its own reverse complement.
    """

    k: int = 8
    w: int = 55
    seed: int = 7
    factor: int = FACTOR_SEED_7

    def __post_init__(self):
        if not 0 < self.k < 32:
            raise ValueError("k must be from 1 to 31")
        if self.w < 1:
            raise ValueError("w must be 1 at least")
        if (self.w + self.k) % 2 == 0:
            raise ValueError("w + k must be odd")
        if not 0 < self.factor < 1 << 64:
            raise ValueError("factor must be a positive 64-bit number")

    @property
    def length(self) -> int:
        return self.w + self.k

    def write(self) -> str:
        """As a line of JSON."""
        return json.dumps(asdict(self))

    @classmethod
    def read(cls, line: str) -> SampleParams:
        return cls(**json.loads(line))

    def report(self) -> str:
        """Parameters and what follows from them, to be read by people."""
        return f"k {self.k}, w {self.w}, seed {self.seed}: fragments of {self.length} bases, one for {(self.w + 1) / 2:.1f} bases expected"

    def require(self, other: SampleParams) -> None:
        """Raise unless the other parameters give the same fragments."""
        if self != other:
            raise ValueError(f"dictionary has {other}, asked for {self}")
