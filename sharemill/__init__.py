"""Exact integer and fixed-point data processing over finite fields, on Spark DataFrames.

The public names are parameters and the modules that hold operators, readers and streams; modules are
imported when they are first asked for, so that tasks load no more than they use."""

from importlib import import_module

from .spec import P31, P32, P61, FieldSpec, most_packed, safe

_MODULES = {
    "functions": ["field", "lagrange", "limbs"],
    "operators": [
        "beaver", "blocks", "chain", "cluster", "collective", "division", "frames", "kv", "linalg", "logs", "membership", "memo", "messages", "metrics", "model",
        "nonlinear", "packed", "plain", "recovery", "sharing", "spatial",
    ],
    "sources": ["arrays", "batches", "tables"],
    "streaming": ["folds", "streams"],
}
_HOMES = {name: home for home, names in _MODULES.items() for name in names}

__all__ = ["P31", "P32", "P61", "FieldSpec", "most_packed", "safe", *sorted(_HOMES)]


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return import_module(f"{__name__}.{_HOMES[name]}.{name}")
