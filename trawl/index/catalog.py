"""Several workspaces in one process: opened when asked for, the idle ones closed oldest first."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from contextlib import contextmanager

from trawl.index.engine import Engine


class Catalog:
    def __init__(self, open_: Callable[[str], Engine], most: int = 4, clock: Callable[[], float] = time.monotonic) -> None:
        self._open, self.most, self._clock = open_, most, clock
        self.engines: dict[str, Engine] = {}
        self._refs: dict[str, int] = {}
        self._used: dict[str, float] = {}
        self._specs: dict[str, object] = {}

    @contextmanager
    def borrow(self, workspace_id: str):  # noqa: ANN201
        if workspace_id not in self.engines:
            while len(self.engines) >= self.most:
                idle = [w for w in self.engines if not self._refs[w]]
                if not idle:
                    raise RuntimeError("all workspaces are in use")
                self.close(min(idle, key=lambda w: (self._used[w], w)))
            self.engines[workspace_id], self._refs[workspace_id] = self._open(workspace_id), 0
        self._refs[workspace_id] += 1
        try:
            yield self.engines[workspace_id]
        finally:
            self._refs[workspace_id] -= 1
            self._used[workspace_id] = self._clock()

    def close(self, workspace_id: str) -> None:
        for d in (self.engines, self._refs, self._used):
            d.pop(workspace_id, None)

    def reload(self, wanted: dict[str, Callable[[], Engine]]) -> None:
        """All of the new engines or none: nothing changes if one cannot be opened."""
        fresh = {w: f() for w, f in wanted.items()}
        busy = [w for w, n in self._refs.items() if n]
        if busy:
            raise RuntimeError(f"in use: {busy}")
        now = self._clock()
        self.engines, self._refs, self._used = fresh, dict.fromkeys(fresh, 0), dict.fromkeys(fresh, now)

    def apply(self, specs: Mapping[str, object], opened: Callable[[str, object], Engine]) -> dict[str, list[str]]:
        """Brings the engines in step with what workspaces are asked for: those whose spec is new or another are opened, those that
        are not asked for any more are closed, the others stay open. All or nothing; what is to be closed or replaced must be idle.
        Returns the names that were added, changed and removed."""
        added = sorted(w for w in specs if w not in self._specs)
        changed = sorted(w for w in specs if w in self._specs and self._specs[w] != specs[w])
        removed = sorted(w for w in self._specs if w not in specs)
        busy = [w for w in (*changed, *removed) if self._refs.get(w)]
        if busy:
            raise RuntimeError(f"in use: {busy}")
        fresh = {w: opened(w, specs[w]) for w in (*added, *changed)}
        for w in removed:
            self.close(w)
        now = self._clock()
        for w, engine in fresh.items():
            self.engines[w], self._refs[w], self._used[w] = engine, self._refs.get(w, 0), now
        self._specs = dict(specs)
        return {"added": added, "changed": changed, "removed": removed}
