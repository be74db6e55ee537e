"""Settings, path aliases, project context and the registry of repositories. They are small and read on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

from ..functions import rules

CONTEXT_CHARS = 4_000
CONTEXT_FILE = "strataloom.context.md"


@dataclass(frozen=True)
class Config:
    root: str
    include: tuple[str, ...] = rules.DEFAULT_INCLUDE
    exclude: tuple[str, ...] = rules.DEFAULT_EXCLUDE
    output: str = ".ai-notes"
    stale_days: int = rules.STALE_DAYS
    language: str = "en"
    llm_threshold: float = 0.4
    high_threshold: float = 0.7
    concurrency: int = 5
    new_source_quota: int = 8
    side_effect_packages: tuple[str, ...] = ()
    api_call_patterns: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not 1 <= self.concurrency <= 20:
            raise ValueError("concurrency must be from 1 to 20")
        for name in ("llm_threshold", "high_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        if self.stale_days < 0:
            raise ValueError("stale_days must not be negative")
        for pattern in self.api_call_patterns:
            try:
                re.compile(pattern)
            except re.error as error:
                raise ValueError(f"not a pattern: {pattern!r}") from error


def load_config(root: str, name: str = "strataloom.json") -> Config:
    """The settings of a JSON file over the defaults; without a readable file the defaults; a wrong value is an error."""
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            own = json.load(f)
    except (OSError, ValueError):
        return Config(root)
    known = {x.name for x in fields(Config)} - {"root"}
    if unknown := own.keys() - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(root, **{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})


def project_context(text: str | None, chars: int = CONTEXT_CHARS) -> str | None:
    """Free text for prompts: trimmed, cut with a mark; nothing of an empty one."""
    own = (text or "").strip()
    return None if not own else own if len(own) <= chars else own[:chars] + "\n[... truncated]"


def load_context(root: str, name: str = CONTEXT_FILE) -> str | None:
    """The project context of a repository; None where there is none to read."""
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return project_context(f.read())
    except (OSError, ValueError):
        return None


def tsconfig_aliases(text: str) -> dict[str, list[str]]:
    """The paths of a tsconfig with comments."""
    try:
        clean = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.DOTALL)
        own = json.loads(re.sub(r",\s*([}\]])", r"\1", clean)).get("compilerOptions", {})
    except ValueError:
        return {}
    base = own.get("baseUrl", ".").strip("./")
    return {k: [f"{base}/{t}".strip("/").removeprefix("./") if base else t.removeprefix("./") for t in v] for k, v in own.get("paths", {}).items()}


def bundler_aliases(text: str) -> dict[str, list[str]]:
    """The string aliases of a bundler's configuration, by pattern: the file is not executed."""
    block = re.search(r"alias\s*:\s*\{(.*?)\}", text, re.DOTALL)
    found = re.findall(r"""['"]?([@~\w$/-]+)['"]?\s*:\s*(?:[\w.]+\(\s*(?:__dirname|import\.meta\.dirname|process\.cwd\(\))\s*,\s*)?['"]([^'"]+)['"]""", block[1]) if block else []
    return {k: [v.removeprefix("./").strip("/")] for k, v in found}


def merged_aliases(tsconfig: str | None, bundlers: dict[str, str]) -> dict[str, list[str]]:
    """The paths of a tsconfig, and over them the aliases of the first bundler's settings (name -> text) that are there."""
    first = next((bundlers[name] for name in rules.BUNDLER_FILES if name in bundlers), None)
    return (tsconfig_aliases(tsconfig) if tsconfig else {}) | (bundler_aliases(first) if first is not None else {})


def repositories(spec: str) -> dict[str, str]:
    """alias -> root of "a=/p,b=/q" or of one path, whose last segment is then its alias; repeated aliases and empty parts are errors."""
    out: dict[str, str] = {}
    for part in (x.strip() for x in spec.split(",")):
        alias, eq, root = (x.strip() for x in part.partition("=")) if "=" in part else (os.path.basename(part.rstrip("/")), "", part)
        if not alias or not root or alias in out:
            raise ValueError(f"not a list of repositories: {spec!r}")
        out[alias] = root
    return out


def inside(root: str, path: str) -> str:
    """path below root; one that leads out of it is an error."""
    own = os.path.normpath(path)
    if os.path.isabs(own) or own.split(os.sep)[0] == "..":
        raise ValueError(f"{path!r} leads out of {root!r}")
    return own
