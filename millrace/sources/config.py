"""Settings from the environment, with defaults."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions.numbers import LAYOUT_BITRATES


def leading_int(text: str | None, default: int) -> int:
    """The whole number a text begins with; ``default`` where there is none or it is 0."""
    found = re.match(r"\s*([+-]?\d+)", text or "")
    return int(found[1]) or default if found else default


@dataclass(frozen=True)
class Config:
    input_dir: str = "/data/input"
    output_dir: str = "/data/output"
    organisation: str = "millrace"
    quality: str = "medium"
    speed: str = "slow"
    cooldown_seconds: int = 30
    library_dirs: tuple[str, ...] = ()
    bitrates: Mapping[str, int] = field(default_factory=lambda: dict(LAYOUT_BITRATES))


def load(env: Mapping[str, str] = os.environ) -> Config:
    """Empty values count as missing."""
    rates = {k: leading_int(env.get("AUDIO_BITRATE_" + k.upper().replace(".", "_")), v) for k, v in LAYOUT_BITRATES.items()}
    base = Config()
    return Config(
        env.get("INPUT_DIR") or base.input_dir, env.get("OUTPUT_DIR") or base.output_dir, env.get("ORGANIZATION") or base.organisation,
        env.get("ENCODER_QUALITY") or base.quality, env.get("ENCODER_SPEED") or base.speed, leading_int(env.get("COOLDOWN_SECONDS"), base.cooldown_seconds),
        tuple(d.strip() for d in env.get("LIBRARY_DIRS", "").split(",") if d.strip()), rates,
    )
