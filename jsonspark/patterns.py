"""Patterns: a literal substring, or a regular expression written r'...'.

The regular expressions follow the linear-time dialect without look-around and
back-references; a pattern that uses them, or is malformed, matches nothing.  In
replacements a group is $1, ${1} or ${name}; a bare $name takes the longest run
of letters, digits and underscores, and an unknown group is empty.
"""

from __future__ import annotations

import re
from functools import lru_cache

REFERENCE = re.compile(r"\$(?:\$|\{([^{}]*)\}|(\w+))", re.ASCII)


def parse(pattern: str) -> tuple[str, str]:
    """("regex", body) for r'...', else ("literal", pattern)."""
    if len(pattern) >= 3 and pattern.startswith("r'") and pattern.endswith("'"):
        return "regex", pattern[2:-1]
    return "literal", pattern


@lru_cache(maxsize=512)
def compiled(body: str) -> re.Pattern | None:
    """The compiled expression, or None if it is malformed or outside the dialect."""
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", body)
    if re.search(r"\(\?(?:[=!>(]|<[=!])|\(\?P[=>]", bare) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", body):
        return None
    body = re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", body)
    body = body.replace(r"\z", r"\Z").replace(r"\h", r"[ \t]") if "\\" in body else body
    try:
        return re.compile(body)
    except (re.error, RecursionError, OverflowError):
        return None


def java_regex(body: str) -> str | None:
    """The expression for Spark's regexp functions, or None if it matches nothing."""
    if compiled(body) is None:
        return None
    return "(?U)" + re.sub(r"\(\?P<", "(?<", body)


def java_replacement(text: str, body: str) -> str:
    """The replacement for Spark's regexp_replace: numbered groups, everything else literal."""
    regex, out, at = compiled(body), [], 0
    for m in REFERENCE.finditer(text):
        out.append(re.sub(r"([\\$])", r"\\\1", text[at : m.start()]))
        at = m.end()
        name = m[1] if m[1] is not None else m[2]
        if name is None:
            out.append(r"\$")
        elif name.isdigit() and int(name) <= regex.groups:
            out.append(f"${int(name)}")
        elif name in regex.groupindex:
            out.append(f"${regex.groupindex[name]}")
    out.append(re.sub(r"([\\$])", r"\\\1", text[at:]))
    return "".join(out)


def unknown_groups(text: str, body: str) -> list[str]:
    """The groups that a replacement refers to and its expression does not have."""
    regex = compiled(body)
    names = [m[1] if m[1] is not None else m[2] for m in REFERENCE.finditer(text)]
    return [n for n in names if n is not None and not (n.isdigit() and int(n) <= regex.groups) and n not in regex.groupindex]


def _expanded(text: str):
    def expand(match: re.Match) -> str:
        def value(ref: re.Match) -> str:
            name = ref[1] if ref[1] is not None else ref[2]
            if name is None:
                return "$"
            key = int(name) if name.isdigit() else name
            try:
                return match[key] or ""
            except IndexError:
                return ""

        return REFERENCE.sub(value, text)

    return expand


def replacer(pairs: tuple[tuple[str, str], ...]):
    """A function that applies all replacements in order."""
    steps = []
    for pattern, text in pairs:
        kind, body = parse(pattern)
        if kind == "literal":
            steps.append(lambda s, a=body, b=text: s.replace(a, b))
        elif (regex := compiled(body)) is not None:
            steps.append(lambda s, r=regex, f=_expanded(text) if "$" in text else (lambda m, t=text: t): r.sub(f, s))

    def apply(s: str) -> str:
        for step in steps:
            s = step(s)
        return s

    return apply if steps else None


def matcher(patterns: tuple[str, ...]):
    """A function that says whether any pattern is found, or None if none can be."""
    tests = []
    for pattern in patterns:
        kind, body = parse(pattern)
        if kind == "literal":
            tests.append(lambda s, a=body: a in s)
        elif (regex := compiled(body)) is not None:
            tests.append(lambda s, r=regex: r.search(s) is not None)
    return (lambda s: any(t(s) for t in tests)) if tests else None
