"""Population definitions, event lists and grid definitions as tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Population:
    class_name: str = ""
    species: str = ""
    species_id: int = -1
    sensing: int = 0
    params: dict[str, str] = field(default_factory=dict)
    priorities: dict[str, int] = field(default_factory=dict)

    def polyline(self, name: str) -> list[tuple[float, float]]:
        numbers = [float(x) for x in self.params[name].split()]
        return list(zip(numbers[::2], numbers[1::2], strict=True))

    def actions(self) -> list[tuple[int, list[str]]]:
        """Actions by ascending priority; equal priorities keep their order."""
        levels: dict[int, list[str]] = {}
        for action, level in self.priorities.items():
            levels.setdefault(level, []).append(action)
        return sorted(levels.items())


def parse_population(text: str) -> Population:
    """A definition: CLASS, SPECIES id name, SENSING n, BEGIN_PARAMS, key = value, PRIO action n, END_PARAMS."""
    pop, inside = Population(), False
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        words = line.split()
        if not words:
            continue
        head = words[0]
        if head == "CLASS":
            pop.class_name = words[1]
        elif head == "SPECIES":
            pop.species_id, pop.species = int(words[1]), words[2]
        elif head == "SENSING":
            pop.sensing = int(words[1])
        elif head == "BEGIN_PARAMS":
            inside = True
        elif head == "END_PARAMS":
            inside = False
        elif head == "PRIO":
            pop.priorities[words[1]] = int(words[2])
        elif inside and "=" in line:
            key, _, value = line.partition("=")
            pop.params[key.strip()] = value.strip()
        else:
            raise ValueError(f"cannot read {raw!r}")
    return pop


_EVENT = re.compile(r"(?P<kind>\w+)(?:\|(?P<what>[^@:]+))?(?::(?P<file>[^@]+))?@(?P<when>.+)")


def parse_event(line: str) -> dict[str, str]:
    """``kind|layers:file@triggers``."""
    found = _EVENT.fullmatch(line.strip().strip('"'))
    if found is None:
        raise ValueError(f"cannot read {line!r}")
    return {k: v or "" for k, v in found.groupdict().items()}


def parse_grid(text: str) -> dict[str, str]:
    """``key = value`` or ``key value`` lines of a lattice definition."""
    out = {}
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if line:
            key, value = re.split(r"\s*=\s*|\s+", line, maxsplit=1)
            out[key] = value
    return out
