"""Where a language model would be asked: a stub and a replay of recorded answers. No number depends on either."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass
from pathlib import Path
from typing import Any


class CacheMiss(LookupError):
    """No recorded answer for a prompt."""


@dataclass(frozen=True)
class Usage:
    calls: int = 0
    tokens_in: int = 0
    tokens_out: int = 0
    wall_ms: float = 0.0

    def cost(self, per_million_in: float, per_million_out: float) -> float:
        return (self.tokens_in * per_million_in + self.tokens_out * per_million_out) / 1e6


def key(system: str, user: str, schema: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps([system, user, schema], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class Stub:
    """Answers every prompt with the same values."""

    def __init__(self, answer: dict[str, Any] | None = None):
        self.answer = answer or {}

    def complete(self, system: str, user: str, schema: dict[str, Any]) -> tuple[dict[str, Any], Usage]:
        return dict(self.answer), Usage()


class Replay:
    """Answers from files named by the prompt's key; records those of another provider if it has one."""

    def __init__(self, folder: Path | str, source: Any = None):
        self.folder, self.source = Path(folder), source

    def complete(self, system: str, user: str, schema: dict[str, Any]) -> tuple[dict[str, Any], Usage]:
        path = self.folder / f"{key(system, user, schema)}.json"
        if path.exists():
            return json.loads(path.read_text(encoding="utf-8")), Usage()
        if self.source is None:
            raise CacheMiss(path.stem)
        begun = time.perf_counter()
        answer, usage = self.source.complete(system, user, schema)
        path.write_text(json.dumps(answer, sort_keys=True, ensure_ascii=False), encoding="utf-8")
        return answer, Usage(usage.calls, usage.tokens_in, usage.tokens_out, 1000 * (time.perf_counter() - begun))
