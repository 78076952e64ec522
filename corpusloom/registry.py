"""Named factories with other names, lazily imported targets and plug-ins of installed packages."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from importlib.metadata import entry_points


def plain_name(name: str) -> str:
    """A name in its one spelling: lower case, underscores."""
    return name.strip().lower().replace("-", "_")


class Registry:
    """Factories by name; a target is a callable or `module:attribute`, which is imported when it is first asked for."""

    def __init__(self, what: str, group: str | None = None):
        self.what, self.group = what, group
        self._targets: dict[str, Callable | str] = {}
        self._aliases: dict[str, str] = {}
        self._searched = group is None

    def add(self, name: str, target: Callable | str | None = None, *aliases: str):
        """Register `target`; without one, a decorator that does. A name that is taken is an error."""
        if target is None:
            return lambda f: self.add(name, f, *aliases) or f
        for n in map(plain_name, (name, *aliases)):
            if n in self._targets or n in self._aliases:
                raise ValueError(f"{self.what} {n!r} is registered already")
        self._targets[plain_name(name)] = target
        self._aliases |= {plain_name(a): plain_name(name) for a in aliases}
        return None

    def names(self) -> list[str]:
        self._search()
        return sorted(self._targets)

    def get(self, name: str) -> Callable:
        key = plain_name(name)
        key = self._aliases.get(key, key)
        if key not in self._targets:
            self._search()
        if key not in self._targets:
            raise KeyError(f"no {self.what} {name!r}; known: {', '.join(sorted(self._targets))}")
        target = self._targets[key]
        if isinstance(target, str):
            module, _, attribute = target.partition(":")
            target = self._targets[key] = getattr(importlib.import_module(module), attribute)
        return target

    def make(self, name: str, *args, **kwargs):
        return self.get(name)(*args, **kwargs)

    def _search(self) -> None:
        """Plug-ins: entry points of the group; names that are taken stay as they are."""
        if not self._searched:
            self._searched = True
            for e in entry_points(group=self.group):
                if plain_name(e.name) not in self._targets:
                    self._targets[plain_name(e.name)] = e.value


#: Transforms of record tables: callables of a frame and options.
TRANSFORMS = Registry("transform", "corpusloom.transforms")
TRANSFORMS.add("clean", "corpusloom.operators.clean:clean_records", "clean_dataset")
TRANSFORMS.add("exact_dedup", "corpusloom.operators.dedup:exact_dedup", "deduplicate")
TRANSFORMS.add("near_dedup", "corpusloom.operators.dedup:near_dedup", "near_deduplicate")
TRANSFORMS.add("language_filter", "corpusloom.operators.clean:language_filter")
TRANSFORMS.add("sequences", "corpusloom.operators.masking:sequences", "pack")
