"""Where each provider keeps its logs, below a home folder."""

from __future__ import annotations

import os
from collections.abc import Mapping

#: provider -> (variable that moves its home, home below the user's, folders or files in that). Fixed values.
PLACES = {
    "claude": ("", ".claude", ["projects"]),
    "codex": ("", ".codex", ["sessions", "archived_sessions"]),
    "copilot": ("", ".copilot", ["session-state"]),
    "gemini": ("", ".gemini", ["tmp"]),
    "grok": ("GROK_HOME", ".grok", ["sessions"]),
    "deepseek": ("DSH_HOME", ".dsh", ["sessions"]),
    "opencode": ("XDG_DATA_HOME", ".local/share", ["opencode/opencode.db"]),
    "cursor": ("", ".cursor", ["chats"]),
    "cursor_tracking": ("", ".cursor", ["ai-tracking/ai-code-tracking.db"]),
    "hermes": ("HERMES_HOME", ".hermes", ["state.db"]),
}


def catalog(home: str, env: Mapping[str, str] = os.environ) -> dict[str, list[str]]:
    """provider -> roots, or store files. A variable that is blank, or an XDG one that is not absolute, counts as unset."""
    found = {}
    for provider, (variable, below, parts) in PLACES.items():
        moved = env.get(variable, "") if variable else ""
        usable = bool(moved.strip()) and (not variable.startswith("XDG_") or os.path.isabs(moved))
        base = moved if usable else os.path.join(home, below)
        found[provider] = [os.path.join(base, p) for p in parts]
    return found
