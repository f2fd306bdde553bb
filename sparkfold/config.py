"""Settings: layers, value parsing and secrets."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace
from pathlib import PurePosixPath

#: Settings that environment variables with this prefix override.
PREFIX = "SPARKFOLD_"


@dataclass(frozen=True)
class Settings:
    """All settings with their defaults."""

    read: tuple[str, ...] = ()
    read_except: tuple[str, ...] = ()
    write: tuple[str, ...] = ()
    export: tuple[str, ...] = ()
    mode: str = "additive"
    delete_keys: tuple[str, ...] = ()
    delete_all_tags: bool = False
    stamp: bool = False
    tagger: str = "sparkfold"
    compute_pages: bool = True
    delete_original: bool = False
    stop_on_error: bool = False
    dry_run: bool = False
    recurse: bool = False
    dest_path: str = "."
    pages: str = ""
    match: str = "auto"
    auto_threshold: float = 0.95
    min_confidence: float = 0.50
    margin: float = 0.10
    solo_threshold: float = 0.85
    effort: str = "balanced"
    prompts: bool = True
    cache_ttl: str = "7d"
    sources: tuple[str, ...] = ()
    per_source: tuple[tuple[str, str, str], ...] = ()  # (source, parameter, value)


def csv(value) -> tuple[str, ...]:
    """Values of a comma-separated text or a list, stripped, without empty ones, distinct in order."""
    parts = value.split(",") if isinstance(value, str) else list(value or ())
    return tuple(dict.fromkeys(x for x in (str(p).strip() for p in parts) if x))


def _typed(kind: str, value):
    if kind.startswith("tuple[str"):
        return csv(value)
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in {"1", "true", "yes", "on"}
    return {"float": float, "int": int, "str": str}.get(kind, lambda v: v)(value)


def layered(*layers: dict, env: dict | None = None, args: dict | None = None) -> Settings:
    """Defaults, then each layer, then environment variables, then arguments; the later wins, None is absence."""
    known = {f.name: str(f.type) for f in fields(Settings)}
    from_env = {k.removeprefix(PREFIX).lower(): v for k, v in (os.environ if env is None else env).items() if k.startswith(PREFIX)}
    out = Settings()
    for layer in (*layers, from_env, args or {}):
        unknown = set(layer) - set(known)
        if unknown and layer is not from_env:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = replace(out, **{k: _typed(known[k], v) for k, v in layer.items() if v is not None and k in known})
    return out


def load_yaml(path: str) -> dict:
    """A settings file."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def ttl_seconds(text: str) -> int:
    """Seconds of a duration such as 7d, 12h, 30m or 45s."""
    found = re.fullmatch(r"\s*(\d+)\s*([dhms])\s*", text.lower())
    if not found:
        raise ValueError(f"{text!r} is no duration; use a number with d, h, m or s")
    return int(found[1]) * {"d": 86400, "h": 3600, "m": 60, "s": 1}[found[2]]


def page_range(text: str) -> tuple[int, int | None] | None:
    """First and last page (inclusive) of ``a:b``; one number is one page, an open end is None; empty text is no range."""
    if not text.strip():
        return None
    first, colon, last = (x.strip() for x in text.partition(":"))
    start = int(first) if first else 0
    return (start, (int(last) if last else None)) if colon else (start, start)


def formats_to_read(settings: Settings, known: list[str]) -> list[str]:
    """Formats to read in their order: those named (or all) without the excepted ones."""
    wanted = set(settings.read or known) - set(settings.read_except)
    return [f for f in known if f in wanted]


def formats_to_write(settings: Settings, file_type: str | None) -> list[str]:
    """Formats to write; a PDF without a choice becomes a zip with ComicInfo."""
    return list(settings.write) or (["comic_info"] if file_type == "PDF" else [])


def delete_keys(*parts) -> tuple[str, ...]:
    """Union of key paths without the root."""
    return tuple(sorted({PurePosixPath(k.replace(".", "/")).as_posix().replace("/", ".") for p in parts for k in csv(p)}))


def redact(text: str, secrets: list[str]) -> str:
    """Text without secrets and without values of key parameters in URLs."""
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        text = text.replace(s, "***")
    return re.sub(r"(?i)((?:api_?key|token|password)=)[^&\s]+", r"\1***", text)


def masked(secret: str | None) -> str:
    """A secret as it may be shown."""
    return "" if not secret else f"{secret[:2]}***" if len(secret) > 8 else "***"
