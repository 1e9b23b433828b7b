"""Options of a reader: checked field by field, kept in a JSON file that is replaced whole.

What a file holds beside the known fields is left out; a value of a wrong type or outside its range falls back to
the default, or to the nearest bound. Options are one small object of the driver, not data.
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

#: Languages of the interface and of translations, engines, tabs, bounds.
INTERFACE = ("it", "en", "fr", "de", "es")
TRANSLATED = ("en", "it", "fr", "de", "es", "pt", "nl", "pl", "ru", "zh", "ja", "ko", "ar", "tr")
ENGINES, TABS = ("google", "microsoft"), ("original", "translated", "images")
ZOOM, FONT, PAGES_HELD = (0.5, 4.0), (10, 16), 20
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")

Check = Callable[[Any, Any], Any]


def one_of(*allowed: str) -> Check:
    return lambda value, default: value if isinstance(value, str) and value in allowed else default


def number(kind: type, low: float, high: float) -> Check:
    def check(value: Any, default: Any) -> Any:
        try:
            return min(kind(high), max(kind(low), kind(value)))
        except (TypeError, ValueError, OverflowError):
            return default

    return check


def flag(value: Any, default: bool) -> bool:
    """Booleans, numbers (0: no) and the usual words; anything else is the default."""
    if isinstance(value, (bool, int, float)):
        return bool(value)
    word = value.strip().lower() if isinstance(value, str) else None
    return word in YES if word in YES + NO else default


def pages(value: Any, default: dict[str, int]) -> dict[str, int]:
    """The last `PAGES_HELD` entries of a map of names to page numbers; entries that are no numbers go first."""
    if not isinstance(value, dict):
        return default
    found = {}
    for name, page in value.items():
        with contextlib.suppress(TypeError, ValueError):
            found[str(name)] = int(page)
    return dict(list(found.items())[-PAGES_HELD:])


def _option(default: Any, check: Check) -> Any:
    how = {"default_factory": default} if callable(default) else {"default": default}
    return field(metadata={"check": check}, **how)


@dataclass(frozen=True)
class Options:
    lang: str = _option("it", one_of(*INTERFACE))
    src_lang: str = _option("auto", one_of("auto", *TRANSLATED))
    dst_lang: str = _option("it", one_of(*TRANSLATED))
    engine: str = _option("google", one_of(*ENGINES))
    zoom: float = _option(3.0, number(float, *ZOOM))
    render_md: bool = _option(True, flag)
    show_header: bool = _option(True, flag)
    remember_tab: bool = _option(True, flag)
    resume_last_page: bool = _option(True, flag)
    save_edits: bool = _option(True, flag)
    font_size: int = _option(12, number(int, *FONT))
    last_tab: str = _option("original", one_of(*TABS))
    last_pages: dict[str, int] = _option(dict, pages)

    @classmethod
    def checked(cls, raw: Any) -> Options:
        """Options from any JSON value; what is missing or wrong takes its default."""
        base = cls()
        given = raw if isinstance(raw, dict) else {}
        return cls(**{f.name: f.metadata["check"](given[f.name], getattr(base, f.name)) for f in fields(cls) if f.name in given})

    @classmethod
    def load(cls, path: str | Path) -> Options:
        """Options of a file; a file that is missing or damaged gives the defaults."""
        try:
            return cls.checked(json.loads(Path(path).read_text(encoding="utf-8")))
        except (OSError, ValueError):
            return cls()

    def save(self, path: str | Path) -> None:
        """Replace the file as a whole: whoever reads it sees the old or the new one, even after a crash."""
        to = Path(path)
        to.parent.mkdir(parents=True, exist_ok=True)
        fd, name = tempfile.mkstemp(dir=to.parent, prefix=f".{to.name}-")
        try:
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                json.dump(asdict(self), f, ensure_ascii=False, indent=2)
                f.flush()
                os.fsync(f.fileno())
            os.replace(name, to)
        except BaseException:
            Path(name).unlink(missing_ok=True)
            raise
