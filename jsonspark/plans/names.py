"""Column names of a flattened frame, planned on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from ..config import Config
from ..kernel import Kernel


@dataclass
class Planned:
    """An output column: its name and the source paths that it is made of, in order."""

    name: str
    sources: list[int]
    array: bool


def plan_names(paths: list[str], config: Config) -> list[Planned]:
    """Exclude by original path, then lower and replace; equal names merge to arrays or the last one wins."""
    k = Kernel(config)
    found: dict[str, list[int]] = {}
    for i, path in enumerate(paths):
        if not (k.excluded_key and k.excluded_key(path)):
            found.setdefault(k._final_key(path), []).append(i)
    out = []
    for name, sources in found.items():
        array = name in k.always or config.handle_key_collision and len(sources) > 1
        out.append(Planned(name, sources if array else sources[-1:], array))
    return out
