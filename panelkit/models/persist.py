"""Fits of this library as JSON: dataclasses of numbers, lists and arrays."""

from __future__ import annotations

import dataclasses
import importlib
import json
import math

import numpy as np


def _out(x):
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        kept = {f.name: _out(getattr(x, f.name)) for f in dataclasses.fields(x) if not f.metadata.get("transient")}
        return {"_class": f"{type(x).__module__}:{type(x).__qualname__}", "fields": kept}
    if isinstance(x, np.ndarray):
        return {"_array": [_out(v) for v in x.ravel().tolist()], "shape": list(x.shape), "dtype": str(x.dtype)}
    if isinstance(x, np.generic):
        return _out(x.item())
    if isinstance(x, dict):
        return {"_dict": [[_out(k), _out(v)] for k, v in x.items()]}
    if isinstance(x, tuple):
        return {"_tuple": [_out(v) for v in x]}
    if isinstance(x, list):
        return [_out(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return {"_float": repr(x)}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise TypeError(f"cannot save a {type(x).__name__}")


def _in(x):
    if isinstance(x, list):
        return [_in(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "_class" in x:
        module, name = x["_class"].split(":")
        if not module.startswith("panelkit."):
            raise ValueError(f"{module} is not part of this library")
        cls = getattr(importlib.import_module(module), name)
        return cls(**{k: _in(v) for k, v in x["fields"].items()})
    if "_array" in x:
        return np.array([_in(v) for v in x["_array"]], dtype=x["dtype"]).reshape(x["shape"])
    if "_dict" in x:
        return {_in(k): _in(v) for k, v in x["_dict"]}
    if "_tuple" in x:
        return tuple(_in(v) for v in x["_tuple"])
    return float(x["_float"])


def dumps(model) -> str:
    return json.dumps(_out(model))


def loads(text: str):
    return _in(json.loads(text))
