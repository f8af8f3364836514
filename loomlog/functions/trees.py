"""Text of nested attribute values: typed trees of the standard export JSON.

A tree is a value of one kind: {"stringValue": ...}, {"intValue": "7"}, {"arrayValue":
{"values": [...]}}, {"kvlistValue": {"values": [{"key": ..., "value": ...}]}} and so on. Its
text is compact JSON: keys sorted, of equal keys the last, bytes as lower-case hex,
numbers that JSON cannot hold as null. Walked with a stack, so any depth is the same.
"""

from __future__ import annotations

import base64
import json
import re

_QUOTE = json.JSONEncoder(ensure_ascii=False).encode
_EXPONENT = re.compile(r"(-?)(\d)(?:\.(\d+))?e([+-]\d+)")


def double_text(value: float) -> str:
    """Shortest digits; plain from 1e-5 up to 1e16, else with an exponent; or null."""
    if value != value or value in (float("inf"), float("-inf")):
        return "null"
    text = repr(value)
    found = _EXPONENT.fullmatch(text)
    if not found:
        return text
    sign, first, rest, power = found[1], found[2], found[3] or "", int(found[4])
    if -6 < power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{first}{rest}"
    return f"{sign}{first}{'.' if rest else ''}{rest}e{power}"


def bytes_of(text: str) -> bytes:
    """Base64 in either alphabet, with or without padding; what is neither is skipped."""
    plain = text.translate({45: "+", 95: "/"}).rstrip("=")
    plain = re.sub(r"[^A-Za-z0-9+/]", "", plain)
    plain = plain[: len(plain) - (len(plain) % 4 == 1)]
    return base64.b64decode(plain + "=" * (-len(plain) % 4))


def _scalar(kind: str, value) -> str:
    if kind == "stringValue":
        return _QUOTE(str(value))
    if kind == "boolValue":
        return "true" if value in (True, "true") else "false"
    if kind == "bytesValue":
        return f'"{bytes_of(str(value)).hex()}"'
    try:
        return str(int(value)) if kind == "intValue" else double_text(float(value))
    except (ValueError, TypeError, OverflowError):
        return "null"


def tree_text(tree: dict | None) -> str:
    """Compact JSON of a parsed tree."""
    out: list[str] = []
    todo: list = [tree]
    while todo:
        item = todo.pop()
        if isinstance(item, str):  # text that is ready
            out.append(item)
            continue
        kind, value = next(((k, v) for k, v in (item or {}).items() if v is not None), (None, None))
        if kind == "arrayValue":
            todo.append("]")
            for n, inner in reversed(list(enumerate(value.get("values") or []))):
                todo.append(inner)
                todo.append("," if n else "[")
            if not value.get("values"):
                out.append("[")
        elif kind == "kvlistValue":
            pairs = {p.get("key") or "": p.get("value") for p in value.get("values") or []}
            todo.append("}")
            for n, key in reversed(list(enumerate(sorted(pairs)))):
                todo.append(pairs[key])
                todo.append(("," if n else "{") + _QUOTE(key) + ":")
            if not pairs:
                out.append("{")
        else:
            out.append("null" if kind is None else _scalar(kind, value))
    return "".join(out)


def nested_text(kind: str, text: str) -> str:
    """Text of a list or key/value list given as raw JSON.

    What a JSON parser cannot follow (thousands of levels) stays as it was written.
    """
    try:
        return tree_text({kind: json.loads(text)})
    except RecursionError:
        return text
