"""The one error class; its texts are part of the interface."""

from __future__ import annotations


class FerryError(Exception):
    def __init__(self, message: str, hint: str | None = None) -> None:
        super().__init__(message if hint is None else f"{message}\nHINT: {hint}")
        self.message, self.hint = message, hint
