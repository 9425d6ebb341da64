"""Settings: defaults, YAML-free overrides, environment and checks."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

LEVELS = {"raw": 0, "light": 1, "strong": 2, "semantic": 3}


@dataclass(frozen=True)
class Config:
    # analysis
    level: str = "strong"
    min_statements: int = 3
    min_lines: int = 6
    window_size: int = 5
    window_min_function: int = 8
    min_window_tokens: int = 5
    shingle_size: int = 7
    hashes: int = 128
    bands: int = 16
    rows: int = 8
    similarity: float = 0.6
    hash_family: str = "portable"  # or fnv: kindred.functions.family
    # scoring
    min_score: float = 0.15
    max_findings: int = 0
    weight_similarity: float = 0.30
    weight_impact: float = 0.25
    weight_refactorability: float = 0.20
    weight_repetition: float = 0.15
    weight_confidence: float = 0.10
    test_penalty: float = 0.5
    generated_penalty: float = 0.3
    small_penalty: float = 0.7
    # paths
    exclude: tuple[str, ...] = field(
        # fixed values
        default=(
            "vendor/**", "**/*.pb.go", "**/mock_*.go", "**/zz_generated*.go", "**/*.min.js", "**/*.min.css",
            "**/*.bundle.js", "**/*.chunk.js", "**/dist/**", "**/build/**", "**/public/packs/**",
            "**/public/vite-dev/**", "**/public/assets/**", "**/coverage/**", "**/obj/**", "**/*.Designer.cs", "**/*.g.cs",
        )
    )
    include_tests: bool = True
    include_vendor: bool = False
    include_generated: bool = False
    follow_symlinks: bool = False
    max_file_size: int = 1 << 20
    ignore_directive: str = "kindred-ignore"
    # output
    format: str = "text"
    log_level: str = "info"
    log_format: str = "text"

    @property
    def level_number(self) -> int:
        """An unknown level counts as strong, and semantic does what strong does."""
        return min(2, LEVELS.get(self.level, 2))

    def check(self) -> list[str]:
        """All that is wrong, sorted."""
        out = []
        least = {"min_statements": 1, "min_lines": 1, "window_size": 2, "window_min_function": 1, "shingle_size": 1, "hashes": 1, "bands": 1, "rows": 1, "max_file_size": 1, "max_findings": 0}
        out += [f"{k} must be {v} at least" for k, v in least.items() if getattr(self, k) < v]
        out += [f"{k} must be within 0 and 1" for k in ("min_score", "similarity", "test_penalty", "generated_penalty", "small_penalty") if not 0 <= getattr(self, k) <= 1]
        if self.bands * self.rows != self.hashes:
            out.append("bands * rows must equal hashes")
        weights = [getattr(self, f.name) for f in fields(self) if f.name.startswith("weight_")]
        if min(weights) < 0 or abs(sum(weights) - 1) > 0.01:
            out.append("weights must not be negative and add up to 1")
        if self.level not in LEVELS:
            out.append(f"level must be one of {', '.join(LEVELS)}")
        if self.hash_family not in ("portable", "fnv"):
            out.append("hash_family must be portable or fnv")
        if self.format not in ("text", "json"):
            out.append("format must be text or json")
        return sorted(out)

    def with_values(self, values: Mapping[str, object]) -> Config:
        """Other values for some keys, cast to the type of the default; unknown keys are errors."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := set(values) - set(kinds):
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")

        def cast(kind, v):
            if kind is bool and isinstance(v, str):
                return v.strip().lower() in ("1", "true", "yes", "on")
            if kind is tuple:
                return tuple(x.strip() for x in v.split(",")) if isinstance(v, str) else tuple(v)
            return kind(v)

        return replace(self, **{k: cast(kinds[k], v) for k, v in values.items()})

    def with_environment(self, prefix: str = "KINDRED_", environment: Mapping[str, str] | None = None) -> Config:
        held = os.environ if environment is None else environment
        names = {f.name: prefix + f.name.upper() for f in fields(self)}
        return self.with_values({k: held[n] for k, n in names.items() if n in held})


def discover() -> str | None:
    """The first settings file that there is: in the working directory, then in the user's."""
    places = [".kindred.yaml", os.path.join(os.path.expanduser("~"), ".config", "kindred", "config.yaml")]
    return next((p for p in places if os.path.exists(p)), None)


def load(path: str | None = None) -> Config:
    """Defaults with the settings of a file, the one discovered if none is named; without a file, the defaults.

    Lines are `key: value`, `section:` with indented settings below, or `- item` of a list. A setting goes by its last
    key, so sections only group them, but for level and format of the section logging. A line that is none of these, and
    an unknown key, are errors.
    """
    path = path or discover()
    if path is None or not os.path.exists(path):
        return Config()
    values, open_key, section = {}, None, None
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            inner = line[:1].isspace()
            line = re.sub(r"(^|\s)#.*", "", line).strip()
            if not line or line == "---":
                continue
            if line.startswith("- ") and open_key:
                values.setdefault(open_key, []).append(line[2:].strip().strip("'\""))
                continue
            key, sep, value = (x.strip() for x in line.partition(":"))
            if not sep:
                raise ValueError(f"{path}:{n}: not a setting")
            section = section if inner else key
            if inner and section == "logging" and key in ("level", "format"):
                key = f"log_{key}"
            open_key = None if value else key
            if value.startswith("["):
                values[key] = [x.strip().strip("'\"") for x in value.strip("[]").split(",") if x.strip()]
            elif value:
                values[key] = value.strip("'\"")
    return Config().with_values(values)
