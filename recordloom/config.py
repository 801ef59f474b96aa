"""Settings of a linkage run. Explicit arguments win over environment variables, these over a JSON file, that over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class NormConfig:
    form: str = "NFKC"
    case: str = "lower"
    punctuation_to_space: bool = True
    fold_latin: bool = True
    max_length: int = 512

    def __post_init__(self) -> None:
        if self.form not in ("NFC", "NFD", "NFKC", "NFKD"):
            raise ValueError(f"unknown Unicode form {self.form!r}")
        if self.case not in ("lower", "casefold"):
            raise ValueError(f"unknown case mode {self.case!r}")


@dataclass(frozen=True)
class KeyConfig:
    """A blocker on many keys a record: the ``rarest`` keys with a document frequency up to ``df_cap``; pairs below
    ``jaccard`` are dropped where it is set."""

    df_cap: int = 1000
    rarest: int = 1
    jaccard: float | None = None

    def __post_init__(self) -> None:
        for name in ("df_cap", "rarest"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer, not {value!r}")
        if self.jaccard is not None and not 0 < float(self.jaccard) <= 1:
            raise ValueError(f"jaccard must be in (0, 1], not {self.jaccard!r}")


@dataclass(frozen=True)
class LinkConfig:
    norm: NormConfig = field(default_factory=NormConfig)
    token: KeyConfig = field(default_factory=lambda: KeyConfig(1000, 1))
    char: KeyConfig = field(default_factory=lambda: KeyConfig(1000, 5, 0.3))
    blockers: tuple[str, ...] = ("exact_name", "token", "char_ngram")
    max_candidates: int | None = None
    val_fraction: float = 0.2
    split_mode: str = "blake2b"
    recall_at: tuple[int, ...] = (10, 25, 50, 100, 200)
    folds: int = 5
    plateau: float = 0.002


def _merged(base: Any, over: dict[str, Any]) -> Any:
    known = {f.name for f in fields(base)}
    if unknown := set(over) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    made = {}
    for name, value in over.items():
        now = getattr(base, name)
        made[name] = _merged(now, value) if is_dataclass(now) and isinstance(value, dict) else tuple(value) if isinstance(now, tuple) else value
    return replace(base, **made)


def load_config(path: str | None = None, overrides: dict[str, Any] | None = None, environ: dict[str, str] | None = None) -> LinkConfig:
    """Settings from a JSON file, then from RECORDLOOM_<NAME> variables (JSON values), then from ``overrides``."""
    config = LinkConfig()
    if path:
        with open(path, encoding="utf-8") as f:
            config = _merged(config, json.load(f))
    environ = os.environ if environ is None else environ
    own = {f.name: environ[key] for f in fields(config) if (key := f"RECORDLOOM_{f.name.upper()}") in environ}
    config = _merged(config, {k: json.loads(v) for k, v in own.items()})
    return _merged(config, overrides or {})
