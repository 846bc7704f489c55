"""Settings as plain dataclasses, with presets, environment overrides and ordered validation."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from graphlib import TopologicalSorter

from .errors import InvalidInputError, NotFoundError

# Names and defaults of the settings.


@dataclasses.dataclass(frozen=True)
class GraphConfig:
    min_node_size: float = 5.0
    max_node_size: float = 30.0
    min_edge_width: float = 0.5
    max_edge_width: float = 5.0
    limit_nodes: int = 1000
    limit_edges: int = 2000
    active_dimensions: tuple[str, ...] = ("lexical",)

    def with_dimensions(self, *names: str) -> "GraphConfig":
        return dataclasses.replace(self, active_dimensions=names)


@dataclasses.dataclass(frozen=True)
class QueueConfig:
    batch_size: int = 50
    max_size: int | None = None
    max_retries: int = 3

    def high_throughput(self) -> "QueueConfig":
        return dataclasses.replace(self, batch_size=self.batch_size * 4)


@dataclasses.dataclass(frozen=True)
class VectorConfig:
    dimension: int = 64
    metric: str = "cosine"
    max_results: int = 100


@dataclasses.dataclass(frozen=True)
class ParserConfig:
    data_dir: str = "data"
    resources: Mapping[str, str] = dataclasses.field(default_factory=lambda: {"openthesaurus": "openthesaurus.jsonl", "odict": "odict.json", "opendict": "opendict.json", "thesaurus": "thesaurus.jsonl", "dbnary": "dbnary.nt"})

    def path(self, name: str) -> str:
        if name not in self.resources:
            raise NotFoundError(f"no resource {name!r}")
        return os.path.join(self.data_dir, self.resources[name])


COMPONENTS = {"graph": GraphConfig, "queue": QueueConfig, "vector": VectorConfig, "parser": ParserConfig}
#: Components that have to be valid before another one is looked at.
DEPENDS = {"graph": ["parser"], "vector": ["parser"], "queue": []}


def truthy(text: str) -> bool:
    return text.strip().lower() in ("true", "yes", "1", "y")


class Settings:
    """All components; values in the environment (GLOSSARA_<COMPONENT>_<FIELD>) replace defaults."""

    def __init__(self, environ: Mapping[str, str] | None = None):
        environ = os.environ if environ is None else environ
        self.components, self.observers = {}, []
        for name, kind in COMPONENTS.items():
            changes = {}
            for field in dataclasses.fields(kind):
                text = environ.get(f"GLOSSARA_{name}_{field.name}".upper())
                if text is not None:
                    old = getattr(kind(), field.name)
                    changes[field.name] = truthy(text) if isinstance(old, bool) else type(old)(text) if isinstance(old, (int, float, str)) else text
            self.components[name] = kind(**changes)

    def get(self, component: str):
        if component not in self.components:
            raise NotFoundError(f"no component {component!r}")
        return self.components[component]

    def set(self, component: str, **changes) -> None:
        try:
            self.components[component] = dataclasses.replace(self.get(component), **changes)
        except TypeError as e:
            raise InvalidInputError(str(e)) from e
        for f in self.observers:
            f(component, changes)

    def order(self) -> list[str]:
        return list(TopologicalSorter({k: DEPENDS.get(k, []) for k in COMPONENTS}).static_order())

    def as_dict(self) -> dict:
        return {k: dataclasses.asdict(v) for k, v in self.components.items()}
