"""Settings of a run: one immutable record, checked when it is made."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# The reasons for which all blocks of a session may be cleared at once.
CLEAR_REASONS = frozenset({"empty_scene", "scene_change", "region_change", "session_end"})


@dataclass(frozen=True)
class Settings:
    """What operators take as parameters; never global."""

    target_lang: str = "ru"
    screen_lines: int = 120
    batch_rows: int = 8
    batch_tokens: int = 512
    call_cap: int = 28
    likeness: float = 0.88
    cache_entries: int = 4000
    game: str | None = None

    def __post_init__(self) -> None:
        for name in ("screen_lines", "batch_rows", "batch_tokens", "call_cap", "cache_entries"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive whole number")
        if not 0.0 < self.likeness <= 1.0:
            raise ValueError("likeness must be above 0 and at most 1")
        if not self.target_lang or not self.target_lang.strip():
            raise ValueError("target_lang must name a language")

    def with_profile(self, profile: dict | None) -> Settings:
        """These settings with those of a profile that are known and set."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in (profile or {}).items() if k in known and v is not None})


def may_clear_all(reason: str | None) -> bool:
    return (reason or "") in CLEAR_REASONS


def fill_template(value, values: dict[str, str]):
    """A decoded JSON value with ``{name}`` in its strings replaced; other braces stay."""
    if isinstance(value, str):
        for k, v in values.items():
            value = value.replace("{" + k + "}", "\x00" + k + "\x00")
        for k, v in values.items():
            value = value.replace("\x00" + k + "\x00", v)
        return value
    if isinstance(value, list):
        return [fill_template(v, values) for v in value]
    if isinstance(value, dict):
        return {k: fill_template(v, values) for k, v in value.items()}
    return value
