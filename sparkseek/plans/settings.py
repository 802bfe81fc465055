"""Settings and saved searches: a small JSON file on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from urllib.parse import urlsplit, urlunsplit

from sparkseek.plans.request import MODES, SearchRequest

# Bounds on saved searches.
MAX_SAVED, MAX_NAME, MAX_QUERY, CUT_NAME = 100, 128, 8192, 125


@dataclass(frozen=True)
class SavedSearch:
    """A named view: a query and a mode."""

    id: str
    name: str
    query: str
    mode: str = "all"

    def request(self) -> SearchRequest:
        return SearchRequest(q=self.query, mode=self.mode)


@dataclass(frozen=True)
class Settings:
    folders: tuple[str, ...] = ()
    excluded_folders: tuple[str, ...] = ()
    scope: str = "folders"
    theme: str = "system"
    semantic: bool = False
    sharp_text: bool = True
    save_clipboard: bool = False
    launch_at_login: bool = False
    hide_on_blur: bool = False
    onboarded: bool = False
    hotkey: str = "Alt+Shift+S"
    copy_latest_hotkey: str = "Alt+Shift+V"
    saved_searches: tuple[SavedSearch, ...] = field(default=())

    def merged(self, patch: dict) -> Settings:
        """With the named fields replaced, if the result is valid; unknown names are left out."""
        known = {f.name for f in fields(self)}
        values = asdict(self) | {k: v for k, v in patch.items() if k in known}
        for name in ("folders", "excluded_folders"):
            values[name] = tuple(values[name])
        values["saved_searches"] = tuple(s if isinstance(s, SavedSearch) else SavedSearch(**s) for s in values["saved_searches"])
        return Settings(**values).checked()

    def checked(self) -> Settings:
        if self.scope not in ("folders", "everywhere") or self.theme not in ("system", "light", "dark"):
            raise ValueError("invalid settings value")
        long = any(len(s.name.encode()) > MAX_NAME or len(s.query.encode()) > MAX_QUERY or s.mode not in MODES for s in self.saved_searches)
        if long or len(self.saved_searches) > MAX_SAVED:
            raise ValueError("saved searches exceed their limits")
        return self


def load(path: str) -> Settings:
    """The settings in the file, or the defaults where there is none."""
    file = Path(path)
    return Settings().merged(json.loads(file.read_text(encoding="utf-8"))) if file.exists() else Settings()


def save(path: str, settings: Settings) -> None:
    """Replaces the file whole, so that it is never half written."""
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    draft = file.with_name(file.name + ".pending")
    with draft.open("w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    draft.replace(file)


def saved_name(query: str) -> str:
    """A name for a saved query of at most 128 bytes; longer ones end in an ellipsis."""
    name = query.strip()
    if len(name.encode()) <= MAX_NAME:
        return name
    return name.encode()[:CUT_NAME].decode(errors="ignore").rstrip() + "…"


def plain_terms(query: str) -> str:
    """The query's words without filters, exclusions and quotes."""
    without = re.sub(r'(^|\s)-?\w+:(?:"[^"]*"|\S+)', " ", query)
    return re.sub(r"(^|\s)-\S+", " ", without).replace('"', "").strip()


def capture_address(url: str) -> str:
    """A page's address for a sidecar: http or https, without credentials and fragment."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError("only regular web pages can be captured")
    host = parts.netloc.rpartition("@")[2]
    return urlunsplit((parts.scheme, host, parts.path or "/", parts.query, ""))
