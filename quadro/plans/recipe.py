"""Recipes: a tabulation and the steps before and after it, as JSON that is checked when read."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from types import UnionType
from typing import get_args, get_type_hints

from quadro.plans import spec as model
from quadro.plans.spec import PlanError, TabulationSpec

VERSION = 1


def _built(kind: type, data: object, where: str) -> object:
    if isinstance(kind, UnionType):
        if data is None:
            return None
        kind = next(k for k in get_args(kind) if k is not type(None))
    if is_dataclass(kind):
        if not isinstance(data, dict):
            raise PlanError(f"{where}: {data!r}")
        hints = get_type_hints(kind, vars(model))
        known = {f.name for f in fields(kind)}
        if unknown := set(data) - known:
            raise PlanError(f"{where}: unknown {', '.join(sorted(unknown))}")
        try:
            return kind(**{k: _built(hints[k], v, f"{where}.{k}") for k, v in data.items()})
        except TypeError as e:
            raise PlanError(f"{where}: {e}") from e
    if getattr(kind, "__origin__", None) is tuple:
        inner = get_args(kind)
        if not isinstance(data, list):
            raise PlanError(f"{where}: {data!r}")
        if inner[-1] is Ellipsis:
            return tuple(_built(inner[0], v, where) for v in data)
        return tuple(_built(k, v, where) for k, v in zip(inner, data, strict=True))
    if kind is float and isinstance(data, (int, float)):
        return float(data)
    if not isinstance(data, kind):
        raise PlanError(f"{where}: {data!r} isn't {kind.__name__}")
    return data


def save(spec: TabulationSpec, operations: list | None = None, note: str = "") -> str:
    """Sorted keys, so equal recipes are equal texts."""
    return json.dumps({"version": VERSION, "spec": json.loads(spec.to_json()), "operations": operations or [], "note": note}, sort_keys=True, ensure_ascii=False)


def load(text: str) -> tuple[TabulationSpec, list[tuple[str, dict]]]:
    """(spec, operations on its result, for tableops.replay)."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise PlanError("no recipe") from e
    if data.get("version") != VERSION:
        raise PlanError(f"recipe version {data.get('version')}")
    return _built(TabulationSpec, data["spec"], "spec"), [(n, dict(a)) for n, a in data.get("operations", [])]
