"""Defaults of a mining run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes of a default run."""

    samples_per_prompt: int = 64
    beta: float = 0.1
    device_batch: int = 1
    accumulation: int = 8
    base_prompts: int = 512
    max_prompt_length: int = 64
    max_target_length: int = 10
    logging_steps: int = 10
    common_words: int = 20_000


DEFAULTS = Settings()
# The earlier default run.
LEGACY = Settings(samples_per_prompt=16, device_batch=2, base_prompts=1024)
