"""Driver-side settings: defaults, overlays, and the choice of a backend. Nothing here touches rows."""

from __future__ import annotations

import json
from collections.abc import Mapping


def load(defaults: Mapping[str, object], *overlays: Mapping[str, object]) -> dict[str, object]:
    """Defaults under the overlays, later ones winning; keys that the defaults lack are left out."""
    out = dict(defaults)
    for o in overlays:
        out |= {k: v for k, v in o.items() if k in defaults}
    return out


def dump(settings: Mapping[str, object], secret: set[str]) -> str:
    """JSON without the secret keys."""
    return json.dumps({k: v for k, v in settings.items() if k not in secret}, indent=2, ensure_ascii=False)


def fill(template: str, values: Mapping[str, object]) -> str:
    """Every {{NAME}} replaced by its value as a JSON literal; texts as they are where they stand in quotes."""
    for k, v in values.items():
        template = template.replace("{{" + k + "}}", v if isinstance(v, str) else json.dumps(v))
    return template


def sources(*slugs: str | None) -> list[str]:
    """The slugs that are not blank."""
    return [s.strip() for s in slugs if s and s.strip()]


def choose(settings: Mapping[str, str], role: str, known: Mapping[str, Mapping[str, str]], default: str, explicit: str | None = None) -> tuple[str, dict[str, str]]:
    """Provider and its details: explicit, else the role's, else the global one, else the default; unknown names fall back."""
    name = (explicit or settings.get(f"provider_{role}") or settings.get("provider") or default).strip().lower()
    name = name if name in known else default
    info = dict(known[name])
    if settings.get(f"model_{role}", "").strip():
        info["model"] = settings[f"model_{role}"].strip()
    if settings.get("base_url", "").strip():
        info["base_url"] = settings["base_url"].strip()
    return name, info


def prompt(system: str, addendum: str = "", facets: Mapping[str, list[str]] | None = None, task: str = "") -> str:
    """System text, addendum, one line for each facet that has terms, and the task; blank parts are left out."""
    lines = [f"{k}: {', '.join(v)}" for k, v in (facets or {}).items() if v]
    return "\n\n".join(p for p in (system.strip(), addendum.strip(), "\n".join(lines), task.strip()) if p)
