"""Errors with stable codes."""

from __future__ import annotations

#: What each code stands for.
CODES = {
    "E001": "JSON parse error",
    "E002": "regex error",
    "E003": "invalid replacement pattern",
    "E004": "invalid JSON structure",
    "E005": "configuration error",
    "E006": "batch processing error",
    "E007": "input validation error",
    "E008": "serialization error",
}


class JsonSparkError(Exception):
    """An engine failure; ``code`` is one of CODES and is part of the text."""

    def __init__(self, code: str, detail: str):
        self.code, self.detail = code, detail
        super().__init__(f"[{code}] {CODES[code]}: {detail}")

    def __reduce__(self):
        return JsonSparkError, (self.code, self.detail)


def at_item(index: int, cause: JsonSparkError) -> JsonSparkError:
    """The error of one item of a batch; the item's own error is its cause."""
    error = JsonSparkError("E006", f"item {index}: {cause}")
    error.__cause__ = cause
    return error
