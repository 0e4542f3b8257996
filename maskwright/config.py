"""Settings. They become literals of the plans; no Spark setting is read or changed."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    key: str = ""
    auto_mask: float = 0.85
    review_floor: float = 0.60
    auto_approve: bool = True
    use_patterns: bool = True
    use_responses: bool = False
    verify: bool = True
    check_originals: bool = True
    #: Pattern hits are replaced by family (an SSN as a national id); False keeps the generic replacement for all but emails and companies.
    by_family: bool = True
    #: Blocks that one request to a language model holds.
    prompt_blocks: int = 100

    def __post_init__(self):
        if not 0 <= self.review_floor <= self.auto_mask <= 1:
            raise ValueError("thresholds must satisfy 0 <= review_floor <= auto_mask <= 1")

    @property
    def secret(self) -> str:
        if not self.key:
            raise ValueError("a key is needed to make replacements")
        return self.key

    @classmethod
    def load(cls, path: str, **over) -> Config:
        """Settings of a flat ``name: value`` file, then the given ones; unknown names are errors, a missing file gives the defaults."""
        known = {f.name: f.type for f in fields(cls)}
        found: dict = {}
        for line in Path(path).read_text().splitlines() if Path(path).exists() else ():
            name, colon, value = line.partition("#")[0].partition(":")
            if not colon or not value.strip():
                continue
            name, value = name.strip(), value.strip().strip("'\"")
            if name not in known:
                raise ValueError(f"unknown setting {name}")
            kind = known[name]
            found[name] = value.lower() in ("true", "yes", "1") if kind == "bool" else float(value) if kind == "float" else int(value) if kind == "int" else value
        return cls(**found | over)
