"""Libraries of data instances and of transforms: what is given to the planner, with lineage, kept as JSON.

An instance is a value or a path with a type and parents. A library is a small catalog on the driver; the data that its
paths name are read by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans.planner import Item, Transform
from strandlake.plans.types import TypeRegistry, parse_types

CATALOG = "id string, type string, path string, value string, parents array<string>"


@dataclass(frozen=True)
class Instance:
    id: str
    type: str
    path: str | None = None
    value: Any = None
    parents: frozenset[str] = frozenset()


@dataclass
class View:
    """A library seen through a mask: the instances of one sample with all that they came from."""

    library: DataLibrary
    ids: frozenset[str]

    def instances(self) -> list[Instance]:
        return [self.library[i] for i in sorted(self.ids)]

    def items(self) -> list[Item]:
        return [Item(i.id, i.type, self.library.ancestors(i.id) & self.ids) for i in self.instances()]


@dataclass
class DataLibrary:
    """Instances by id. Types are checked against those that were added; parents must be there before their children."""

    path: str
    types: TypeRegistry = field(default_factory=TypeRegistry)
    known: dict[str, Instance] = field(default_factory=dict)

    def add_types(self, namespace: str, types: Mapping[str, dict] | str) -> DataLibrary:
        """types: declarations, or the text of a file of them."""
        self.types.add(namespace, parse_types(types) if isinstance(types, str) else types)
        return self

    def _add(self, x: Instance) -> str:
        if x.type not in self.types.declared:
            raise KeyError(f"unknown type {x.type}")
        lacking = x.parents - set(self.known)
        if lacking:
            raise KeyError(f"unknown parents {', '.join(sorted(lacking))}")
        if x.id in self.known:
            raise ValueError(f"{x.id} is there already")
        self.known[x.id] = x
        return x.id

    def add_value(self, name: str, value: Any, type: str, parents: Iterable[str] = ()) -> str:
        return self._add(Instance(name, type, value=value, parents=frozenset(parents)))

    def add_item(self, path: str, type: str, parents: Iterable[str] = (), name: str | None = None) -> str:
        return self._add(Instance(name or path.rstrip("/").rsplit("/", 1)[-1], type, path=path, parents=frozenset(parents)))

    def purge(self) -> None:
        """Forgets all instances; their files stay."""
        self.known.clear()

    def get_type(self, id: str) -> str:
        return self.known[id].type

    def __getitem__(self, id: str) -> Instance:
        return self.known[id]

    def __iter__(self) -> Iterator[Instance]:
        return iter(self.known.values())

    def __len__(self) -> int:
        return len(self.known)

    def ancestors(self, id: str) -> frozenset[str]:
        out: set[str] = set()
        todo = list(self.known[id].parents)
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += self.known[x].parents
        return frozenset(out)

    def as_view(self, mask: Iterable[str]) -> View:
        """The instances of the mask and their ancestors."""
        ids = frozenset(mask)
        return View(self, ids.union(*(self.ancestors(i) for i in ids)) if ids else ids)

    def as_samples(self, type: str) -> list[View]:
        """One view for each instance whose type satisfies the one asked for: it, what it came from, and what came from it."""
        heads = [i.id for i in self if self.types.satisfies(i.type, type)]
        return [self.as_view([h, *(i.id for i in self if h in self.ancestors(i.id))]) for h in heads]

    def items(self) -> list[Item]:
        return self.as_view(self.known).items()

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalog as a table; ``planner.lineage`` takes it."""
        return spark.createDataFrame([(i.id, i.type, i.path, None if i.value is None else json.dumps(i.value), sorted(i.parents)) for i in self], CATALOG)

    def save(self, spark: SparkSession) -> None:
        """Writes the catalog and the types under the path."""
        types = [(name, json.dumps(body)) for name, body in sorted(self.types.declared.items())]
        spark.createDataFrame(types, "name string, body string").coalesce(1).write.mode("overwrite").json(f"{self.path}/types")
        self.frame(spark).coalesce(1).write.mode("overwrite").json(f"{self.path}/catalog")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DataLibrary:
        out = cls(path)
        for r in spark.read.schema("name string, body string").json(f"{path}/types").collect():
            out.types.declared[r["name"]] = json.loads(r["body"])
        for r in spark.read.schema(CATALOG).json(f"{path}/catalog").collect():
            value = None if r["value"] is None else json.loads(r["value"])
            out.known[r["id"]] = Instance(r["id"], r["type"], r["path"], value, frozenset(r["parents"] or ()))
        return out

    def localize(self, spark: SparkSession, to: str) -> DataLibrary:
        """Copies the files that paths name into a folder and points the instances there."""
        sc = spark.sparkContext
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
        for i in list(self):
            if i.path is None:
                continue
            src, dst = jvm.org.apache.hadoop.fs.Path(i.path), jvm.org.apache.hadoop.fs.Path(f"{to}/{i.id}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, True, conf)
            self.known[i.id] = Instance(i.id, i.type, f"{to}/{i.id}", i.value, i.parents)
        return self


@dataclass
class TransformLibrary:
    """Transforms by name."""

    known: dict[str, Transform] = field(default_factory=dict)

    def add(self, *transforms: Transform) -> TransformLibrary:
        for t in transforms:
            self.known[t.name] = t
        return self

    def add_stub(self, name: str) -> Transform:
        """A transform with a name only, to be filled in."""
        self.add(Transform(name))
        return self.known[name]

    def __getitem__(self, name: str) -> Transform:
        return self.known[name]

    def __iter__(self) -> Iterator[tuple[str, Transform]]:
        return iter(sorted(self.known.items()))

    def transforms(self) -> list[Transform]:
        return [t for _, t in self]


@dataclass
class Targets:
    """What is asked for: types, each with the types or ids that must lie above it."""

    wanted: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    def add(self, type: str, parents: Iterable[str] = ()) -> Targets:
        self.wanted.append((type, tuple(parents)))
        return self

    def __iter__(self) -> Iterator[tuple[str, tuple[str, ...]]]:
        return iter(self.wanted)
