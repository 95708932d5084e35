"""What comes in and goes out as JSON: strict requests, results, redacted status, progress."""

from __future__ import annotations

import json
import math
import re
import time
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame

from trawl.functions.text import PATH_IN_TEXT
from trawl.index.snapshot import Files, read_json, write_json

#: Most bytes of a request; most names of failed files that are kept.
MOST_BYTES, MOST_FAILED = 1 << 20, 20


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    limit: int = 0
    path_glob: str | None = None
    top_k: int | None = None
    workspace_id: str = ""


def parse_request(body: bytes) -> SearchRequest:
    """One JSON object with known fields of the right types and nothing after it."""
    if len(body) > MOST_BYTES:
        raise ValueError("the request is too large")
    value = json.loads(body)
    known = {f.name for f in fields(SearchRequest)}
    if not isinstance(value, dict) or set(value) - known:
        raise ValueError("an object with known fields is asked for")
    for name, v in value.items():
        whole = name in ("limit", "top_k")
        if v is not None and (not isinstance(v, int if whole else str) or isinstance(v, bool)):
            raise ValueError(f"{name} has another type")
    return SearchRequest(**value)


def result_json(hits: DataFrame, request: SearchRequest, message: str = "") -> str:
    """The hits of a search, a bounded list, as JSON."""
    return json.dumps({"query": request.query, "results": [r.asDict() for r in hits.collect()]} | ({"message": message} if message else {}), ensure_ascii=False, indent=2)


def redacted(status: dict) -> dict:
    """A status without path fields, and with absolute paths cut out of its texts."""
    out = {}
    for k, v in status.items():
        if k.endswith(("path", "paths", "root", "dir")):
            continue
        out[k] = redacted(v) if isinstance(v, dict) else re.sub(PATH_IN_TEXT, "<redacted>", v) if isinstance(v, str) else v
    return out


@dataclass
class Progress:
    """How far an indexing run is, kept in a small file that is replaced whole."""

    running: bool = False
    files_total: int = 0
    files_done: int = 0
    started: float = 0.0
    updated: float = 0.0
    failed_files: list[str] = field(default_factory=list)
    error: str = ""

    @classmethod
    def load(cls, files: Files) -> Progress:
        """What the file says; idle without one."""
        return cls(**(read_json(files, "PROGRESS.json") or {}))

    def save(self, files: Files, now: float | None = None) -> None:
        self.updated = time.time() if now is None else now
        write_json(files, "PROGRESS.json", asdict(self))

    def add_failed(self, path: str) -> None:
        if path not in self.failed_files and len(self.failed_files) < MOST_FAILED:
            self.failed_files.append(path)

    @property
    def percent(self) -> float:
        return round(100 * self.files_done / self.files_total, 1) if self.files_total > 0 else 0.0

    def seconds_left(self, now: float) -> int:
        if not 0 < self.files_done < self.files_total:
            return 0
        return math.ceil((now - self.started) / self.files_done * (self.files_total - self.files_done))

    def stalled(self, now: float, after_s: float = 120) -> bool:
        return self.running and now - self.updated > after_s
