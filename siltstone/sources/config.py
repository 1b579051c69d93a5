"""Settings from the environment; credentials come from nowhere else."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    user: str = "user"
    version: int = 1
    output: str = "outputs"
    model_url: str = ""
    model_name: str = ""
    model_key: str = field(default="", repr=False)
    forced_tool: bool = True
    delay_s: float = 0.5
    top_n: int = 25
    max_chars: int = 80_000
    batch: int = 40

    @classmethod
    def from_env(cls, env=os.environ, prefix: str = "SILTSTONE_") -> Settings:
        kinds = {"version": int, "delay_s": float, "top_n": int, "max_chars": int, "batch": int, "forced_tool": lambda s: s.lower() not in ("0", "false", "no")}
        found = {n: env[prefix + n.upper()] for n in cls.__dataclass_fields__ if prefix + n.upper() in env}
        return cls(**{n: kinds.get(n, str)(v) for n, v in found.items()})


def tool_choice(settings: Settings, name: str):
    """The request's tool option: the named tool if forced, else left to the model."""
    return {"type": "function", "function": {"name": name}} if settings.forced_tool else "auto"
