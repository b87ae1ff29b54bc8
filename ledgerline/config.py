"""Run settings: defaults, a mapping over them, and environment overrides LEDGERLINE_<NAME>."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from .functions.scalars import run_tag


@dataclass(frozen=True)
class Settings:
    dataset: str = "bank"
    kind: str = ""
    step: float = 1.0
    step_unit: str = "days"
    width: float = 1.0
    echo: bool = False
    days_echo: float = 3.0
    K: int = 7
    task: str = "nowcast"
    n_val: int = 2
    n_test: int = 2
    store: str = ""
    require_store: bool = False

    @property
    def tag(self) -> str:
        return run_tag(self.step, self.step_unit, self.days_echo if self.echo else None, None if self.echo else self.width)

    @property
    def drops_between_windows(self) -> bool:
        """Whether windows narrower than the step leave gaps."""
        return not self.echo and self.width < self.step


def truth(text: str) -> bool:
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off", ""):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


def resolve(given: Mapping | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Defaults, then ``given``, then the environment. A store of 'off' means none."""
    env = os.environ if env is None else env
    out = replace(Settings(), **{k: v for k, v in (given or {}).items() if k in {f.name for f in fields(Settings)}})
    for f in fields(Settings):
        text = env.get(f"LEDGERLINE_{f.name.upper()}")
        if text is not None:
            old = getattr(out, f.name)
            out = replace(out, **{f.name: truth(text) if isinstance(old, bool) else type(old)(text)})
    return replace(out, store="") if out.store.lower() == "off" else out
