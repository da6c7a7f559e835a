"""What a site's robots file allows, for many paths at once."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: str, agent: str) -> tuple[list[tuple[bool, str]], float | None]:
    """(rules, crawl delay) of the groups that name the agent, or else those for all: (allow?, pattern)."""
    groups: dict[str, tuple[list, list]] = {}
    names: list[str] = []
    open_ = False
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
        elif key in ("allow", "disallow", "crawl-delay"):
            open_ = False
            for n in names:
                rules, delays = groups.setdefault(n, ([], []))
                if key == "crawl-delay":
                    delays.append(float(value))
                elif value:
                    rules.append((key == "allow", value))
    own = next((g for n, g in groups.items() if n != "*" and n in agent.lower()), groups.get("*", ([], [])))
    return own[0], max(own[1], default=None)


def allowed(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The longest pattern that matches decides, allow before disallow at one length; without one, a path is allowed."""
    out = F.lit(True)
    for allow, pattern in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        regex = "^" + ".*".join(re.escape(p) for p in pattern.rstrip("$").split("*")) + ("$" if pattern.endswith("$") else "")
        out = F.when(path.rlike(regex), F.lit(allow)).otherwise(out)
    return out
