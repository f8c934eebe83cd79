"""A bounded memo of materialised DataFrames."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame

from tidewright.session import checkpointed


class Memo:
    """Keeps the last `size` results written to the shared folder, so that they outlive executors; the one used longest ago is released."""

    def __init__(self, size: int = 4):
        self.size, self.held = size, OrderedDict()

    def get(self, key: Hashable, build: Callable[[], DataFrame]) -> DataFrame:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        self.held[key] = checkpointed(build())
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return self.held[key]
