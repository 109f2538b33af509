"""Settings, typed, from the environment and a file of NAME=value lines; the environment goes first."""

from __future__ import annotations

import os
import typing
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "QUIRE_"


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values."""

    store_url: str = "file:///tmp/quire"
    review_threshold: float = 0.5
    use_calibration: bool = True
    batch_size: int = 1
    batch_wait_ms: int = 100
    max_file_mb: int = 200
    max_pages: int = 2000
    max_children: int = 500
    max_depth: int = 3
    max_image_pixels: int = 120_000_000
    max_deliveries: int = 3
    max_backlog: int = 1000
    claim_idle_s: int = 120
    worker_max_docs: int = 32
    ocr_backend: str = "auto"


def _value(kind: type, text: str) -> object:
    if kind is bool:
        if text.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"not a truth value: {text!r}")
        return text.lower() in ("1", "true", "yes", "on")
    return kind(text)


def load(env: typing.Mapping[str, str] | None = None, file: str | Path | None = ".env") -> Settings:
    """Settings by name; unknown names are passed over, a value of the wrong type is an error."""
    given: dict[str, str] = {}
    if file and Path(file).is_file():
        for line in Path(file).read_text(encoding="utf-8").splitlines():
            name, found, value = line.partition("=")
            if found and not line.lstrip().startswith("#"):
                given[name.strip()] = value.strip().strip("\"'")
    given |= dict(os.environ if env is None else env)
    kinds = typing.get_type_hints(Settings)
    return Settings(**{f.name: _value(kinds[f.name], given[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in given})


def ocr_backend(requested: str, platform: str, answers: bool) -> str:
    """The reader of page images: what is asked for, else the platform's own where it is there and answers."""
    return requested if requested != "auto" else "apple" if platform == "darwin" and answers else "rapid"
