"""Models are functions from relations to a relation, declared with their grain, key and inputs.

A graph makes each model's lazy DataFrame once; nothing is stored, so Catalyst sees a query's whole graph and prunes and
pushes down across models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources import Source


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    key: str | None
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]

    @property
    def grain(self) -> str:
        return (self.build.__doc__ or "").split("\n")[0]


MODELS: dict[str, Model] = {}


def model(layer: str, key: str | None, *inputs: str):
    """Registers a function as a model; it gets its inputs in order. Sources are named `source.<table>`."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if f.__name__ in MODELS:
            raise ValueError(f"two models are called {f.__name__}")
        if missing := [i for i in inputs if not i.startswith("source.") and i not in MODELS]:
            raise ValueError(f"{f.__name__} names {missing}, which aren't declared before it")
        MODELS[f.__name__] = Model(f.__name__, layer, key, inputs, f)
        return f

    return add


class Graph:
    def __init__(self, source: Source, spark=None):
        self.source, self.spark, self._made = source, spark, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name.startswith("source."):
            return self.source.table(name.removeprefix("source."))
        if name not in MODELS:
            raise KeyError(f"no such model: {name}")
        if name not in self._made:
            m = MODELS[name]
            self._made[name] = m.build(*(self[i] for i in m.inputs)) if m.inputs else m.build(self.spark)
        return self._made[name]

    def order(self) -> list[str]:
        """All models, each after its inputs."""
        return list(MODELS)

    def build(self, folder: str, layers: tuple[str, ...] = ("mart",)) -> dict[str, str]:
        """Writes the models of these layers as Parquet tables; their paths by name."""
        out = {}
        for name, m in MODELS.items():
            if m.layer in layers:
                out[name] = f"{folder}/{name}.parquet"
                self[name].write.mode("overwrite").parquet(out[name])
        return out
