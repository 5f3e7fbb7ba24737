"""The document kernel: strict JSON in, flattened, rebuilt or cleaned JSON out.

Pure Python without Spark; it runs on executors once an Arrow batch.  Objects
are parsed to lists of pairs, so order and duplicate keys survive, and numbers
keep their text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from .config import Config
from .convert import convert
from .errors import JsonSparkError
from .patterns import matcher, replacer


class Obj(list):
    """An object: (key, value) pairs in document order, duplicates included."""


class Num(str):
    """The text of a number."""


class Raw(str):
    """A piece of finished JSON text."""


DROP = object()
_index = re.compile(r"0|[1-9][0-9]*")
_ascii_lower = {c: c + 32 for c in range(65, 91)}
_escapes = {chr(c): f"\\u{c:04x}" for c in range(32)} | {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_special = re.compile(r'[\x00-\x1f"\\]')
_blank = " \t\n\r"


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(object_pairs_hook=Obj, parse_int=Num, parse_float=Num, parse_constant=_constant)


def parse(text: str):
    """The value of a JSON text; E004 for a malformed object or array, E001 for another malformed text."""
    text = text.strip(_blank)
    try:
        return _decoder.decode(text)
    except RecursionError:
        raise JsonSparkError("E004", "the document is nested too deeply") from None
    except ValueError as e:
        raise JsonSparkError("E004" if text[:1] in ("{", "[") else "E001", str(e)) from None


def value_of(fragment: str):
    """The value of a piece of JSON text that the kernel has made; plain scalars need no parser."""
    first = fragment[0]
    if first == '"' and "\\" not in fragment:
        return fragment[1:-1]
    if first in "-0123456789":
        return Num(fragment)
    if first in "tfn":
        return {"t": True, "f": False, "n": None}[first]
    return parse(fragment)


def quoted(text: str) -> str:
    """A JSON string; only quotes, backslashes and control characters are escaped."""
    return f'"{_special.sub(lambda m: _escapes[m[0]], text)}"'


def render(value) -> str:
    """Compact JSON text of a parsed value."""
    if isinstance(value, (Num, Raw)):
        return str(value)
    if isinstance(value, str):
        return quoted(value)
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, Obj):
        return "{" + ",".join(f"{quoted(k)}:{render(v)}" for k, v in value) + "}"
    return "[" + ",".join(map(render, value)) + "]"


class Kernel:
    """A configuration made ready: patterns compiled, steps chosen."""

    def __init__(self, config: Config):
        self.config = c = config.checked()
        self.rewrite_key = replacer(c.key_replacements)
        self.rewrite_value = replacer(c.value_replacements)
        self.excluded_key = matcher(c.key_exclusions)
        self.excluded_value = matcher(c.value_exclusions)
        self.always = frozenset(c.always_array_keys)
        self.run = {"flatten": self.flatten, "unflatten": self.unflatten, "normal": self.normal}[c.mode]

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return self.run(text)
        except RecursionError:
            raise JsonSparkError("E004", "the document is nested too deeply") from None

    # Values

    def scalar(self, value, at_root: bool = False):
        """A scalar's final JSON text, or DROP; no filter applies at the root."""
        c = self.config
        if not isinstance(value, str) or isinstance(value, Num):
            text = render(value)
            if not at_root and (value is None and c.remove_nulls or self.excluded_value and self.excluded_value(text)):
                return DROP
            return text
        if not at_root and value == "" and c.remove_empty_strings:
            return DROP
        changed = self.rewrite_value(value) if self.rewrite_value else value
        if not at_root and changed == "" and c.remove_empty_strings:
            return DROP
        found = convert(changed, c) if c.converts else None
        if found and found[1] is not None:
            if not at_root and (found[1] == "null" and c.remove_nulls or self.excluded_value and self.excluded_value(found[1])):
                return DROP
            return found[1]
        if not at_root and self.excluded_value and self.excluded_value(changed):
            return DROP
        return quoted(changed)

    def _final_key(self, key: str) -> str:
        if self.config.lowercase_keys:
            key = key.translate(_ascii_lower)
        return self.rewrite_key(key) if self.rewrite_key else key

    # Flatten

    def leaves(self, value) -> list[tuple[str, str]]:
        """(path, JSON text) of the leaves that stay, in document order, by their original paths."""
        c, out, stack = self.config, [], [("", value)]
        separator, excluded = c.separator, self.excluded_key
        while stack:
            path, value = stack.pop()
            if isinstance(value, list):
                is_object = isinstance(value, Obj)
                if not value:
                    if not (c.remove_empty_objects if is_object else c.remove_empty_arrays):
                        out.append((path, "{}" if is_object else "[]"))
                    continue
                head = path + separator if path else ""
                children = [(head + k, v) for k, v in value] if is_object else [(f"{head}{i}", v) for i, v in enumerate(value)]
                if is_object and excluded:
                    children = [x for x in children if not excluded(x[0])]
                stack.extend(reversed(children))
            elif (text := self.scalar(value)) is not DROP:
                out.append((path, text))
        return out

    def resolved(self, leaves: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Leaves under their final keys: collisions merged, or the last one kept, in order of first sight."""
        groups: dict[str, list[str]] = {}
        for path, text in leaves:
            groups.setdefault(self._final_key(path), []).append(text)
        merge = self.config.handle_key_collision
        return [(k, f"[{','.join(v)}]" if k in self.always or merge and len(v) > 1 else v[-1]) for k, v in groups.items()]

    def entries(self, text: str) -> list[tuple[str, str]]:
        """The result's top-level (key, JSON text) pairs, keys unique (the last of equal ones wins)."""
        if self.config.mode != "flatten":
            value = parse(self.run(text))
            if not isinstance(value, Obj):
                raise JsonSparkError("E004", "the document is not an object")
            return list({k: render(v) for k, v in value}.items())
        value = self._document(text)
        if not isinstance(value, list):
            raise JsonSparkError("E004", "the document is neither an object nor an array")
        return self.resolved(self.leaves(value)) if value else []

    def _document(self, text: str):
        if not text.strip(_blank):
            raise JsonSparkError("E007", "empty JSON input")
        return parse(text)

    def flatten(self, text: str) -> str:
        value = self._document(text)
        if not isinstance(value, list):
            return self.scalar(value, at_root=True)
        if not value:
            return "{}"
        leaves = self.leaves(value)
        if self.config.changes_keys:
            leaves = self.resolved(leaves)
        return "{" + ",".join(f"{quoted(k)}:{v}" for k, v in leaves) + "}"

    # Unflatten

    def unflatten(self, text: str) -> str:
        if not text.strip(_blank):
            return "{}"
        value = parse(text)
        if not isinstance(value, list):
            return self.scalar(value, at_root=True)
        if not isinstance(value, Obj):
            return "{}"
        c = self.config
        groups: dict[str, list] = {}
        for key, v in value:
            key = self._final_key(key)
            if self.excluded_key and self.excluded_key(key):
                continue
            groups.setdefault(key, []).append(self._extracted(v))
        root: dict = {}
        for key, values in groups.items():
            if len(values) > 1 and c.handle_key_collision:
                leaf = Raw(f"[{','.join(t for t, _ in values)}]"), False
            else:
                leaf = values[-1]
            self._placed(root, key.split(c.separator), leaf)
        return self._tree(root, at_root=True)

    def _extracted(self, value) -> tuple[str, bool]:
        """(JSON text, whether it is a scalar); nothing is filtered yet."""
        if isinstance(value, list):
            return render(value), False
        if isinstance(value, str) and not isinstance(value, Num):
            changed = self.rewrite_value(value) if self.rewrite_value else value
            found = convert(changed, self.config) if self.config.converts else None
            return (found[1] if found and found[1] is not None else quoted(changed)), True
        return render(value), True

    @staticmethod
    def _placed(root: dict, parts: list[str], leaf: tuple[str, bool]) -> None:
        node = root
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise JsonSparkError("E004", f"{part!r} is a value and cannot have children")
        node[parts[-1]] = leaf

    def _tree(self, node, at_root: bool = False):
        c = self.config
        if isinstance(node, tuple):
            text, is_scalar = node
            gone = (
                text == "null" and c.remove_nulls or text == '""' and c.remove_empty_strings
                or text == "{}" and c.remove_empty_objects or text == "[]" and c.remove_empty_arrays
                or is_scalar and self.excluded_value and self.excluded_value(text)
            )
            return DROP if gone else text
        if not at_root and all(_index.fullmatch(k) and len(k) <= 20 and int(k) < 2**64 for k in node):
            last = max(map(int, node))
            if last > c.max_array_index:
                raise JsonSparkError("E007", f"array index {last} exceeds max_array_index ({c.max_array_index})")
            gap = self._tree(("null", True))
            items = [self._tree(node[str(i)]) if str(i) in node else gap for i in range(last + 1)]
            items = [x for x in items if x is not DROP]
            return DROP if not items and c.remove_empty_arrays else f"[{','.join(items)}]"
        pairs = [f"{quoted(k)}:{t}" for k, v in node.items() if (t := self._tree(v)) is not DROP]
        return DROP if not pairs and c.remove_empty_objects and not at_root else "{" + ",".join(pairs) + "}"

    # Normal

    def normal(self, text: str) -> str:
        if not text.strip(_blank):
            return text
        value = parse(text)
        if not isinstance(value, list):
            return self.scalar(value, at_root=True)
        found = self._cleaned(value)
        return ("{}" if isinstance(value, Obj) else "[]") if found is DROP else found

    def _cleaned(self, value):
        c = self.config
        if not isinstance(value, list):
            return self.scalar(value)
        if not isinstance(value, Obj):
            items = [t for v in value if (t := self._cleaned(v)) is not DROP]
            return DROP if not items and c.remove_empty_arrays else f"[{','.join(items)}]"
        pairs: list[tuple[str, str]] = []
        for key, v in value:
            key = self.rewrite_key(key) if self.rewrite_key else key
            key = key.lower() if c.lowercase_keys else key
            if self.excluded_key and self.excluded_key(key):
                continue
            if (text := self._cleaned(v)) is not DROP:
                pairs.append((key, text))
        if c.handle_key_collision:
            groups: dict[str, list[str]] = {}
            for key, text in pairs:
                groups.setdefault(key, []).append(text)
            pairs = [(k, f"[{','.join(v)}]" if len(v) > 1 else v[0]) for k, v in groups.items()]
        if not pairs and c.remove_empty_objects:
            return DROP
        return "{" + ",".join(f"{quoted(k)}:{t}" for k, t in pairs) + "}"


@lru_cache(maxsize=32)
def kernel(config_json: str) -> Kernel:
    """The kernel of a configuration that travels as JSON; made once a worker."""
    return Kernel(Config.from_json(config_json))
