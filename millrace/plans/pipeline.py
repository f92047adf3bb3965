"""Pipelines described as a JSON graph of named operators.

Running one calls each operator on the DataFrames of its inputs, in dependency
order. That only builds a logical plan; Catalyst optimises and runs it when a sink asks.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from .registry import get_operator, operators
from .reuse import result_name, reused


@dataclass
class Step:
    id: str
    operator: str
    params: dict
    disabled: bool = False
    use_cache: bool = False
    inputs: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Run:
    """What a run gave: DataFrames per step and port, history, outputs and row counts."""

    frames: dict[tuple[str, str], DataFrame]
    history: list[dict] = field(default_factory=list)
    outputs: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    observed: dict[str, Observation] = field(default_factory=dict)
    parents: dict[str, list[str]] = field(default_factory=dict)
    #: For each step the seconds of the sinks that it fed; steps that fed none have no row counts.
    fed: dict[str, float] = field(default_factory=dict)
    #: Steps whose rows were read from the table of an earlier run, and steps written once for several sinks.
    reused: list[str] = field(default_factory=list)
    shared: list[str] = field(default_factory=list)
    seconds: float = 0.0

    def frame(self, step: str, port: str = "out") -> DataFrame:
        return self.frames[step, port]

    def metrics(self) -> list[dict]:
        """Rows in, out and removed per step, counted while the sinks wrote them, and these sinks' time.

        Steps that fed no sink, as in a dry run, are left out: nothing has counted their rows.
        """
        rows = {step: seen.get["rows"] for step, seen in self.observed.items() if step in self.fed}
        report = []
        for step, count in rows.items():
            known = [rows[p] for p in self.parents[step] if p in rows]
            before = sum(known) if known else None
            report.append(
                {
                    "step": step,
                    "rows_in": before,
                    "rows_out": count,
                    "removed": None if before is None else before - count,
                    "seconds": self.fed[step],
                    "rows_per_second": count / self.fed[step] if self.fed[step] else None,
                }
            )
        return report


def _fill(value: Any, variables: Mapping[str, Any]) -> Any:
    """Replaces ${NAME} by its value; a text that is one variable keeps the value's type."""
    if isinstance(value, dict):
        return {k: _fill(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [_fill(v, variables) for v in value]
    if not isinstance(value, str):
        return value

    def lookup(name: str) -> Any:
        if name not in variables:
            raise ValueError(f"Variable '{name}' is not set")
        return variables[name]

    whole = re.fullmatch(r"\$\{(\w+)\}", value)
    if whole:
        return lookup(whole.group(1))
    return re.sub(r"\$\{(\w+)\}", lambda m: str(lookup(m.group(1))), value)


def _steps(spec: Mapping, variables: Mapping[str, Any]) -> list[Step]:
    nodes = [n for n in spec.get("nodes", []) if n.get("type", "pipelineNode") != "commentNode"]
    steps = []
    for node in nodes:
        data = node.get("data", {})
        params = _fill(data.get("params") or {}, variables)
        steps.append(
            Step(node["id"], data.get("typeId", ""), params, bool(data.get("disabled")), bool(data.get("use_cache")))
        )
    return steps


def _connect(steps: list[Step], spec: Mapping, problems: list[str]) -> None:
    by_id = {s.id: s for s in steps}
    for edge in spec.get("edges", []):
        source, target = by_id.get(edge["source"]), by_id.get(edge["target"])
        if source is None or target is None:
            problems.append(f"Edge {edge['source']} -> {edge['target']} names an unknown step")
            continue
        known = operators().get(target.operator)
        ports = known.inputs if known else ("in",)
        port = edge.get("targetHandle")
        # Shared handles such as "in" mean the next free input.
        if port not in ports:
            port = next((p for p in ports if p not in target.inputs), None)
        if port is None or port in target.inputs:
            problems.append(f"Step '{target.id}' has more connections than inputs")
            continue
        outputs = operators()[source.operator].outputs if source.operator in operators() else ("out",)
        out = edge.get("sourceHandle")
        target.inputs[port] = (source.id, out if out in outputs else outputs[0])


def _examine(spec: Mapping, variables: Mapping[str, Any], bound: set[str]) -> tuple[list[Step], list[str], list[str]]:
    """Steps in dependency order, with problems and warnings."""
    steps = _steps(spec, variables)
    problems, warnings = [], []
    ids = [s.id for s in steps]
    problems += [f"Step id '{i}' occurs more than once" for i in sorted({i for i in ids if ids.count(i) > 1})]
    if not steps:
        problems.append("The pipeline has no steps")
    _connect(steps, spec, problems)
    used = {source for s in steps for source, _ in s.inputs.values()}
    for step in steps:
        known = operators().get(step.operator)
        if known is None:
            problems.append(f"Step '{step.id}' names the unknown operator '{step.operator}'")
            continue
        if step.id not in bound:
            problems += [f"Step '{step.id}': {text}" for text in known.problems(step.params)]
            needed = known.inputs[:1] if step.disabled else known.inputs
            problems += [f"Step '{step.id}': input '{p}' is not connected" for p in needed if p not in step.inputs]
        if len(steps) > 1 and not step.inputs and step.id not in used:
            warnings.append(f"Step '{step.id}' is not connected to any other")
    order = TopologicalSorter({s.id: {source for source, _ in s.inputs.values()} for s in steps})
    try:
        by_id = {s.id: s for s in steps}
        steps = [by_id[i] for i in order.static_order()]
    except CycleError as error:
        problems.append(f"The steps form a cycle: {error.args[1]}")
    return steps, problems, warnings


def _load(spec: Mapping | str) -> Mapping:
    return json.loads(spec) if isinstance(spec, str) else spec


def check_pipeline(spec: Mapping | str, variables: Mapping[str, Any] | None = None) -> tuple[list[str], list[str]]:
    """Problems and warnings of a description, without running it."""
    spec = _load(spec)
    _, problems, warnings = _examine(spec, {**spec.get("variables", {}), **(variables or {})}, set())
    return problems, warnings


def run_pipeline(
    spark: SparkSession,
    spec: Mapping | str,
    variables: Mapping[str, Any] | None = None,
    dry_run: bool = False,
    frames: Mapping[str, DataFrame] | None = None,
    metrics: bool = False,
) -> Run:
    """Runs a description. ``dry_run`` builds everything and skips the sinks.

    ``frames`` gives the output of steps by id, in place of reading it. A disabled step
    passes its first input through. ``metrics`` counts the rows of each step as the sinks
    write; no job is added.

    A step on the way to several sinks is written once, to a table in the shared folder that they
    read. With ``use_cache`` that table is named by the plan of the step and the versions of its
    input files, and a later run of any session reads it as long as both are the same. A step over
    rows that come from no file, or of a run with ``metrics``, is kept in the session instead, and
    released at the end.
    """
    spec, frames = _load(spec), frames or {}
    values = {**spec.get("variables", {}), **(variables or {})}
    steps, problems, warnings = _examine(spec, values, set(frames))
    if problems:
        raise ValueError("Invalid pipeline: " + "; ".join(problems))
    run = Run({}, warnings=warnings)
    started = time.monotonic()
    forks = set() if dry_run else _forks(steps)
    cached: list[DataFrame] = []
    try:
        for step in steps:
            _run_step(spark, step, run, frames, dry_run, metrics, step.id in forks, cached)
    finally:
        for frame in cached:
            frame.unpersist()
    run.seconds = time.monotonic() - started
    return run


def _run_step(spark, step: Step, run: Run, frames: Mapping, dry_run: bool, metrics: bool, fork: bool, cached: list[DataFrame]) -> None:
    """Calls the operator of a step on the frames before it, or the sink it is."""
    named = get_operator(step.operator)
    inputs = [run.frames[step.inputs[p]] for p in named.inputs if p in step.inputs]
    if step.id in frames:
        result = frames[step.id]
    elif step.disabled:
        result = inputs[0]
    else:
        settings = named.settings(step.params)
        run.history.append({"step": step.id, "name": named.name, "parameters": settings})
        if named.kind == "sink":
            if not dry_run:
                began = time.monotonic()
                named.run(*inputs, **settings)
                took = time.monotonic() - began
                run.outputs.append({"step": step.id, "operator": named.name, "path": settings.get("path")})
                for name in _ancestors([source for source, _ in step.inputs.values()], run.parents):
                    run.fed[name] = run.fed.get(name, 0.0) + took
            return
        result = named.run(spark, **settings) if named.kind == "source" else named.run(*inputs, **settings)
    results = result if isinstance(result, dict) else {named.outputs[0]: result}
    run.parents[step.id] = [source for source, _ in step.inputs.values()]
    for port, frame in results.items():
        if metrics and port == named.outputs[0]:
            run.observed[step.id] = Observation(f"{step.id}-{id(run)}")
            frame = frame.observe(run.observed[step.id], F.count(F.lit(1)).alias("rows"))
        run.frames[step.id, port] = _kept(step, frame, run, dry_run, metrics, fork, cached)


def _kept(step: Step, frame: DataFrame, run: Run, dry_run: bool, metrics: bool, fork: bool, cached: list[DataFrame]) -> DataFrame:
    """The frame of a step, or the table that stands for it."""
    if frame.isStreaming or dry_run:
        return frame
    if step.use_cache:
        # Where rows are counted the steps before have to run.
        name = None if metrics else result_name(frame)
        if name is None:
            cached.append(frame.persist())
            return cached[-1]
        table, there = reused(frame, name)
        if there and step.id not in run.reused:
            run.reused.append(step.id)
        return table
    if fork and step.id not in run.shared:
        run.shared.append(step.id)
    return written(frame, "shared") if fork else frame


def _forks(steps: list[Step]) -> set[str]:
    """Steps whose output goes several ways that end in sinks, but for columnar files, which are read again as cheaply."""
    ends: dict[str, set[str]] = {}
    ways: dict[str, int] = {}
    for step in reversed(steps):
        named = get_operator(step.operator)
        if named.kind == "sink":
            ends[step.id] = {step.id}
        for source in {source for source, _ in step.inputs.values()} if ends.get(step.id) else ():
            ways[source] = ways.get(source, 0) + 1
            ends.setdefault(source, set()).update(ends[step.id])
    by_id = {s.id: s for s in steps}
    return {i for i, n in ways.items() if n > 1 and len(ends[i]) > 1 and by_id[i].operator != "load_parquet"}


def _ancestors(steps: list[str], parents: Mapping[str, list[str]]) -> set[str]:
    found, todo = set(), list(steps)
    while todo:
        if (step := todo.pop()) not in found:
            found.add(step)
            todo += parents.get(step, [])
    return found
