"""Objects for Python workers."""

from __future__ import annotations

from typing import Any

from pyspark import Broadcast, SparkContext, cloudpickle


class Shipped:
    """A broadcast object, pickled by value; ``open()`` makes it anew from what the worker holds on disk."""

    def __init__(self, context: SparkContext, thing: Any):
        self.bytes: Broadcast = context.broadcast(cloudpickle.dumps(thing))

    def open(self) -> Any:
        thing = cloudpickle.loads(self.bytes.value)
        self.bytes.__dict__.pop("_value", None)  # the pickled form need not stay in memory
        return thing
