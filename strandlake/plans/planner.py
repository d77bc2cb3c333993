"""Transforms with typed requirements and products, and a planner that chains them back from targets.

A plan is a list of steps in order; running it hands each step's DataFrames to its function, which returns
lazy DataFrames, so Spark sees one plan for each target and runs nothing before an action.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.plans.types import Props, TypeRegistry


@dataclass(frozen=True)
class Need:
    name: str
    type: str
    parents: frozenset[str] = frozenset()  # names of needs that must be ancestors of this one


@dataclass(frozen=True)
class Resources:
    """What a scheduler would be asked for; Spark takes none of it."""

    cpus: int | None = None
    memory_gb: int | None = None
    hours: float | None = None

    def override(self, other: Resources) -> Resources:
        return Resources(other.cpus or self.cpus, other.memory_gb or self.memory_gb, other.hours or self.hours)


@dataclass(eq=False)
class Transform:
    """products: groups of (name, type), of which a run yields one; most transforms have a single group."""

    name: str
    needs: list[Need] = field(default_factory=list)
    products: list[dict[str, str]] = field(default_factory=lambda: [{}])
    group_by: str | None = None
    batch_size: int = 1
    resources: Resources = Resources()
    checks: dict[str, str] = field(default_factory=dict)  # product: a condition that each of its rows meets
    fn: Callable[..., Mapping[str, DataFrame]] | None = None

    def need(self, name: str, type: str, *parents: str) -> Transform:
        self.needs.append(Need(name, type, frozenset(parents)))
        return self

    def product(self, name: str, type: str) -> Transform:
        self.products[-1][name] = type
        return self

    def check(self, name: str, condition: str) -> Transform:
        """A post-condition: every row of the product meets it."""
        self.checks[name] = condition
        return self

    def or_product(self, name: str, type: str) -> Transform:
        """Begins another group of products."""
        self.products.append({name: type})
        return self


@dataclass(frozen=True)
class Item:
    """A given or planned data instance; ancestors hold the ids of all that it came from."""

    id: str
    type: str
    ancestors: frozenset[str] = frozenset()
    step: str | None = None


@dataclass(frozen=True)
class Step:
    id: str
    transform: str
    inputs: tuple[tuple[str, str], ...]
    outputs: tuple[tuple[str, str], ...]


@dataclass
class Plan:
    steps: list[Step]
    targets: dict[str, str]
    ok: bool
    missing: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple[int, str, str, str]]:
        return [(i, s.transform, ",".join(f"{k}={v}" for k, v in s.inputs), ",".join(v for _, v in s.outputs)) for i, s in enumerate(self.steps)]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "step int, transform string, inputs string, outputs string")

    def dot(self) -> str:
        """The graph in the DOT language."""
        edges = [f'  "{v}" -> "{s.transform}"; ' for s in self.steps for _, v in s.inputs] + [f'  "{s.transform}" -> "{v}";' for s in self.steps for _, v in s.outputs]
        return "digraph plan {\n" + "\n".join(dict.fromkeys(edges)) + "\n}"


class Planner:
    """Chooses, for each type asked for, a given item if one fits, else the transform with the fewest steps; ties go by name.

    Parents of a need must be ancestors of what is chosen for it. Types that say how to get images and libraries are
    resources: they are taken as given where no item fits. A transform is used once on the way to a target, which ends every chain.
    """

    def __init__(self, types: TypeRegistry, transforms: Iterable[Transform], free: tuple[str, ...] = ("containers::", "lib::", "ref::", "taxonomy::gtdb", "taxonomy::metabuli_ref")):
        self.types, self.transforms, self.free = types, sorted(transforms, key=lambda t: t.name), free

    def _fits(self, have: str | Props, want: str) -> bool:
        return self.types.satisfies(have, want)

    def _solve(self, want: str, above: frozenset[str], items: list[Item], busy: frozenset[str]) -> tuple[Item, tuple[Step, ...]] | None:
        given = [i for i in items if self._fits(i.type, want) and above <= i.ancestors | {i.id}]
        if given:
            return min(given, key=lambda i: (len(self.types.flat(i.type)), i.id)), ()
        best = None
        for t in self.transforms:
            if t.name in busy:
                continue
            made = [(g, n, ty) for g, group in enumerate(t.products) for n, ty in group.items() if self._fits(ty, want)]
            if not made:
                continue
            got = self._inputs(t, above, items, busy | {t.name})
            if got is None:
                continue
            chosen, steps = got
            came = frozenset().union(*(c.ancestors | {c.id} for c in chosen.values())) if chosen else frozenset()
            if not above <= came:
                continue
            g, n, ty = made[0]
            step = Step(f"{t.name}({','.join(sorted(c.id for c in chosen.values()))})", t.name, tuple((k, c.id) for k, c in chosen.items()), tuple((k, f"{t.name}.{k}") for k in t.products[g]))
            all_steps = tuple(dict.fromkeys((*steps, step)))
            if best is None or len(all_steps) < len(best[1]):
                best = Item(f"{t.name}.{n}", ty, came, step.id), all_steps
        return best

    def _inputs(self, t: Transform, above: frozenset[str], items: list[Item], busy: frozenset[str]) -> tuple[dict[str, Item], tuple[Step, ...]] | None:
        def go(k: int, chosen: dict[str, Item], steps: tuple[Step, ...]) -> tuple[dict[str, Item], tuple[Step, ...]] | None:
            if k == len(t.needs):
                came = frozenset().union(*(c.ancestors | {c.id} for c in chosen.values())) if chosen else frozenset()
                return (chosen, steps) if above <= came else None
            need = t.needs[k]
            if need.type.startswith(self.free) and not any(self._fits(i.type, need.type) for i in items):
                return go(k + 1, chosen | {need.name: Item(need.type, need.type)}, steps)
            up = frozenset(chosen[p].id for p in need.parents)
            # a needed item may come from any given one; those that lie above the target are tried first
            options = [i for i in items if self._fits(i.type, need.type) and up <= i.ancestors | {i.id}]
            for i in sorted(options, key=lambda i: (not (above & (i.ancestors | {i.id})), i.id)):
                got = go(k + 1, chosen | {need.name: i}, steps)
                if got is not None:
                    return got
            made = self._solve(need.type, up, [i for i in items if i not in options], busy)
            if made is None:
                return None
            return go(k + 1, chosen | {need.name: made[0]}, tuple(dict.fromkeys((*steps, *made[1]))))

        return go(0, {}, ())

    def plan(self, items: Iterable[Item], targets: Iterable[tuple[str, Iterable[str]]]) -> Plan:
        """targets: (type, what must lie above it: ids, or types of targets before it, whose planned instances later targets may use)."""
        items, steps, out, missing = list(items), (), {}, []
        for want, above in targets:
            got = self._solve(want, frozenset(out.get(a, a) for a in above), items, frozenset())
            if got is None:
                missing.append(want)
                continue
            out[want] = got[0].id
            if got[0].step is not None:
                items.append(got[0])
            steps = tuple(dict.fromkeys((*steps, *got[1])))
        return Plan(list(steps), out, not missing, missing)

    def limits(self, overrides: Mapping[Any, Resources] | None = None) -> dict[str, Resources]:
        """Resources of every transform; overrides go by ``all`` or ``*``, then by name or by the transform itself, which wins."""
        overrides = {k.name if isinstance(k, Transform) else k: v for k, v in (overrides or {}).items()}
        unknown = set(overrides) - {t.name for t in self.transforms} - {"all", "*"}
        if unknown:
            raise KeyError(f"no transform named {', '.join(sorted(unknown))}")
        out = {}
        for t in self.transforms:
            got = t.resources
            for name in ("all", "*", t.name):
                got = got.override(overrides.get(name, Resources()))
            out[t.name] = got
        return out

    def run(self, plan: Plan, data: Mapping[str, Any], lineage: DataFrame | None = None, **given: Any) -> dict[str, DataFrame]:
        """DataFrames of the targets, from those of the given items; ``given`` are further arguments of the steps that take them.

        A DataFrame with a column ``sample`` holds all instances of its type. Before a step, each such input gets ``group``: the instance of the
        transform's ``group_by`` need that its sample came from by the lineage (id, ancestor), or its sample itself. For a transform with a
        batch size the input that it groups by also gets ``batch``, numbers of that many samples each. A step that lacks a product raises an error.
        """
        have, known, made = dict(data), {t.name: t for t in self.transforms}, {}
        for s in plan.steps:
            t = known[s.transform]
            if t.fn is None:
                raise NotImplementedError(f"{t.name} needs an outside program; register a function for it")
            args = {k: have.get(v) for k, v in s.inputs}
            heads = args.get(t.group_by) if t.group_by else None
            for k, x in args.items():
                if isinstance(x, DataFrame) and "sample" in x.columns:
                    args[k] = grouped(x, None if k == t.group_by else heads, lineage)
            if t.batch_size > 1 and isinstance(heads, DataFrame) and "sample" in heads.columns:
                args[t.group_by] = with_batches(args[t.group_by], t.batch_size)
            takes = inspect.signature(t.fn).parameters
            got = t.fn(**args, **{k: v for k, v in given.items() if k in takes})
            lacking = [k for k, _ in s.outputs if k not in got]
            if lacking:
                raise RuntimeError(f"{t.name} did not make {', '.join(lacking)}")
            have |= {v: got[k] for k, v in s.outputs}
            made |= {v: (t.name, k, got[k], t.checks.get(k)) for k, v in s.outputs}
        self.made = made
        return {want: have[i] for want, i in plan.targets.items()}

    def verify(self) -> list[tuple[str, str, bool]]:
        """(transform, product, success) of the last run: a product has rows and each meets its post-condition. Runs the products."""
        out = []
        for name, product, frame, condition in self.made.values():
            bad = frame.where(f"not coalesce({condition}, false)").limit(1).count() if condition else 0
            out.append((name, product, not bad and not frame.isEmpty()))
        return out


def grouped(x: DataFrame, heads: DataFrame | None, lineage: DataFrame | None) -> DataFrame:
    """Adds group to rows with a sample: the one of the samples of heads that is its ancestor, else the sample itself."""
    if heads is None or lineage is None or "sample" not in heads.columns:
        return x.withColumn("group", F.col("sample"))
    up = lineage.join(heads.select(F.col("sample").alias("ancestor")).distinct(), "ancestor", "left_semi")
    up = up.groupBy(F.col("id").alias("sample")).agg(F.min("ancestor").alias("group"))
    return x.join(up, "sample", "left").withColumn("group", F.coalesce("group", "sample"))


def attached(samples: DataFrame, resources: DataFrame, name: str = "resource") -> DataFrame:
    """Every sample with every resource (images, reference databases), of which there are a few; ``name`` is the struct that holds them."""
    few = resources.agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in resources.columns))).alias(name))
    return samples.crossJoin(F.broadcast(few)).withColumn(name, F.explode(name))  # one row


def with_batches(x: DataFrame, size: int) -> DataFrame:
    """Adds batch to rows with a sample: numbers of ``size`` samples each, in order."""
    from strandlake.operators.reads import batches

    return x.join(batches(x.select("sample").distinct(), "sample", size), "sample")


def _ways(catalog: DataFrame, jump: DataFrame) -> DataFrame:
    """The lineage of items with one parent each, from (id, ancestor) one level up: a round knows ways of twice as many levels, and jumps as far. A ring ends when a round finds nothing new."""
    known = workspace.table(catalog.select("id", F.col("id").alias("ancestor")).distinct(), "lineage")
    n = known.count()
    while not jump.isEmpty():
        # a parent that is no item of the catalog has no way of its own
        further = jump.join(known.select(F.col("id").alias("m"), F.col("ancestor").alias("far")), F.col("ancestor") == F.col("m"), "left")
        known = workspace.table(known.unionByName(further.select("id", F.coalesce("far", "ancestor").alias("ancestor"))).distinct(), "lineage")
        n, before = known.count(), n
        if n == before:
            break
        jump = workspace.table(jump.join(jump.select(F.col("id").alias("m"), F.col("ancestor").alias("far")), F.col("ancestor") == F.col("m")).select("id", F.col("far").alias("ancestor")), "jumps")
    return known


def lineage(catalog: DataFrame) -> DataFrame:
    """(id, ancestor) of a catalog (id, type, parents array): each item with itself and everything above it, however far.

    A round goes one level up from what the last one found and is written, so that the plan stays small; cycles end as
    what is known is not followed again. Where no item has two parents rounds double the way instead, so that what is
    known is shuffled as often as the logarithm of the longest way.
    """
    up = workspace.table(catalog.select(F.col("id").alias("ancestor"), F.explode("parents").alias("parent")).distinct(), "parents")
    if up.groupBy("ancestor").count().where("count > 1").isEmpty():
        return _ways(catalog, up.select(F.col("ancestor").alias("id"), F.col("parent").alias("ancestor")))
    front = workspace.table(catalog.select("id", F.col("id").alias("ancestor")).distinct(), "lineage")
    out = front
    while front.limit(1).count():
        front = front.join(up, "ancestor").select("id", F.col("parent").alias("ancestor")).distinct().join(out, ["id", "ancestor"], "left_anti")
        front = workspace.table(front, "lineage")
        out = out.union(front)
    return out
