"""Plugins: named, versioned extensions that own derived tables, with migrations between versions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Migration:
    """From one version to another by steps, each a SQL text or a callable that takes the session."""

    start: str | None
    end: str
    steps: tuple

    def __post_init__(self):
        if bad := [s for s in self.steps if not (isinstance(s, str) or callable(s))]:
            raise TypeError(f"not a step: {bad[0]!r}")


class Plugin:
    name = ""
    current = ""
    migrations: tuple[Migration, ...] = ()

    def __init__(self):
        starts = [m.start for m in self.migrations]
        if len(set(starts)) < len(starts):
            raise ValueError("two migrations start at one version")
        self.path(None)

    def path(self, version: str | None) -> list[Migration]:
        """Migrations from a version to the current one."""
        by, out, seen = {m.start: m for m in self.migrations}, [], set()
        while version != self.current:
            if version in seen or version not in by:
                raise ValueError(f"{self.current} can't be reached from {version}")
            seen.add(version)
            out.append(by[version])
            version = by[version].end
        return out

    def post_index_rebuild(self, index) -> None: ...

    def post_transaction(self, index) -> None: ...


class Registry:
    """Plugins of an index; versions are kept as a JSON text by the caller's load and save."""

    def __init__(self, load: Callable[[], str | None], save: Callable[[str], None]):
        self.load, self.save = load, save
        self.plugins: dict[str, Plugin] = {}

    def versions(self) -> dict[str, str]:
        return json.loads(self.load() or "{}")

    def add(self, spark, plugin: Plugin) -> None:
        versions = self.versions()
        for m in plugin.path(versions.get(plugin.name)):
            for step in m.steps:
                spark.sql(step) if isinstance(step, str) else step(spark)
        self.save(json.dumps(versions | {plugin.name: plugin.current}))
        self.plugins[plugin.name] = plugin

    def rebuilt(self, index) -> None:
        for p in self.plugins.values():
            p.post_index_rebuild(index)

    def changed(self, index) -> None:
        for p in self.plugins.values():
            p.post_transaction(index)
