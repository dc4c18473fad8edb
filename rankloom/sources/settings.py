"""Settings on the driver: env files, precedence, policies, and the guard of private paths."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from pathlib import Path

POLICY = {"tau": 2.5, "cand_cap": 30, "max_len": 128, "timeout_ms": 200, "context_clip_max_chars": 50}  # fixed values
# Words in paths that tell of personal data.
_PRIVATE = re.compile(r"private|personal|usage|ime[-_]?usage|conversion[-_]?log|rerank[-_]?requests|chat|secret", re.IGNORECASE)


def read_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank lines and lines without = are skipped, quotes around a value dropped."""
    found = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, equals, value = line.strip().partition("=")
        if equals and not key.startswith("#"):
            found[key.strip()] = value.strip().strip("'\"")
    return found


def resolve(name: str, given: str | None, environment: Mapping[str, str], file: Mapping[str, str], default: str | None = None) -> str | None:
    """The value given on the command line, else in the environment, else in the file."""
    return next((x for x in (given, environment.get(name), file.get(name)) if x), default)


def read_policy(path: str | None, environment: Mapping[str, str] | None = None) -> dict:
    """Defaults, overridden by a JSON file, overridden by RANKLOOM_... variables."""
    policy = dict(POLICY)
    if path:
        policy |= json.loads(Path(path).read_text(encoding="utf-8"))
    for key, old in list(policy.items()):
        value = (environment or {}).get(f"RANKLOOM_{key.upper()}")
        if value is not None:
            policy[key] = type(old)(value)
    return policy


def ensure_public(prefix: str | None, *paths: str) -> None:
    """Refuse paths, or comma-separated lists of them, that tell of personal data, log files, and with a prefix those outside of it."""
    inside = Path(prefix).as_posix().rstrip("/") + "/" if prefix else ""
    for path in (x.strip().replace("\\", "/") for raw in paths for x in (raw or "").split(",")):
        if path and (_PRIVATE.search(path) or path.lower().endswith(".log") or ".." in path.split("/") or not Path(path).as_posix().startswith(inside)):
            raise ValueError(f"not a public path: {path}")


def float_list(text: str) -> list[float]:
    """Sweep values of a comma list, each once, in order."""
    return list(dict.fromkeys(float(x) for x in text.split(",") if x.strip()))
