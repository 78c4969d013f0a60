"""Cleaning options, checked once on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class CleanConfig:
    """Options of a cleaning run.

    Numbers may be given as text.  A switch must be a real boolean: the text
    ``"false"`` is an error here, not a silent True.  Unknown keys given to
    :meth:`from_dict` are kept in ``extra`` and used by nothing.
    """

    duplicate_threshold: float = 0.85
    outlier_z_threshold: float = 3.0
    chunk_size: int = 10000
    enable_ai: bool = True
    ai_confidence_threshold: float = 0.7
    use_ai_for_unmatched_only: bool = False
    ai_vendor_enabled: bool = True
    ai_category_enabled: bool = True
    ai_analysis_enabled: bool = False
    # Null texts become the word 'None' when set; by default they stay null.
    stringify_nulls: bool = False
    # Duplicates and outliers are judged per slice of chunk_size rows when set.
    chunked: bool = False
    extra: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "float":
                value = float(value)
                if math.isnan(value):
                    raise ValueError(f"{f.name} must be a number")
                object.__setattr__(self, f.name, value)
            elif f.type == "int":
                object.__setattr__(self, f.name, int(value))
            elif f.type == "bool" and not isinstance(value, bool):
                raise TypeError(f"{f.name} must be a boolean, got {value!r}")
        if self.duplicate_threshold < 0:
            raise ValueError("duplicate_threshold must not be negative")
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be at least 1")

    @classmethod
    def from_dict(cls, options: Mapping[str, Any] | None = None) -> CleanConfig:
        options = dict(options or {})
        known = {f.name for f in fields(cls)} - {"extra"}
        extra = {k: v for k, v in options.items() if k not in known}
        return cls(**{k: v for k, v in options.items() if k in known}, extra=extra)

    @property
    def vendor_step(self) -> bool:
        return self.enable_ai and self.ai_vendor_enabled

    @property
    def category_step(self) -> bool:
        return self.enable_ai and self.ai_category_enabled

    @property
    def analysis_step(self) -> bool:
        return self.enable_ai and self.ai_analysis_enabled
