"""Provider reply bodies: finding the reply inside whatever the provider wrapped around it.

Bodies come as an object, a one-element list, a wrapper object with one key, or any of these once
more encoded as a JSON string; arrays come as arrays, lone objects, objects keyed by position, or
JSON strings.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(null)|(true)|(false)|(NaN|-?Infinity)|(-?(?:0|[1-9]\d*))((?:\.\d+)?(?:[eE][-+]?\d+)?)")


def _atom(text: str, at: int):
    """(value, end) of a string, number or constant."""
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1)
    m = _ATOM.match(text, at)
    if not m:
        raise ValueError(f"no value at {at}")
    null, true, false, special, whole, rest = m.groups()
    value = None if null else True if true else False if false else float(special) if special else float(whole + rest) if rest else int(whole)
    return value, m.end()


def stacked(text: str):
    """One JSON document read with a stack of its own, to any depth; ValueError if it is not complete."""
    stack: list = []  # open arrays and objects
    keys: list = []  # the key that waits for its value, per open container
    at, done, root = _SPACE.match(text).end(), False, None
    while True:
        # a value, or the end of an empty container
        c = text[at : at + 1]
        if stack and c in ("]", "}") and not stack[-1] and keys[-1] is None and text[at] == ("]" if isinstance(stack[-1], list) else "}"):
            value, at = stack.pop(), at + 1
            keys.pop()
        elif stack and isinstance(stack[-1], dict) and keys[-1] is None:
            if c != '"':
                raise ValueError(f"no key at {at}")
            keys[-1], at = scanstring(text, at + 1)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = _SPACE.match(text, at + 1).end()
            continue
        elif c in ("[", "{") and c:
            stack.append([] if c == "[" else {})
            keys.append(None)
            at = _SPACE.match(text, at + 1).end()
            continue
        else:
            value, at = _atom(text, at)
        # the value goes where it belongs, and so does every container that it ends
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                root, done = value, True
                break
            top = stack[-1]
            if isinstance(top, list):
                top.append(value)
            else:
                top[keys[-1]] = value
                keys[-1] = None
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] in ("]", "}"):
                    raise ValueError(f"no value at {at}")
                break
            if c != ("]" if isinstance(top, list) else "}"):
                raise ValueError(f"no end at {at}")
            value, at = stack.pop(), at + 1
            keys.pop()
        if done:
            if at != len(text):
                raise ValueError(f"more at {at}")
            return root


def loads(text: str):
    """One JSON document of any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return stacked(text)


def decoded(x):
    """x, or what it encodes if it is a string holding a JSON array or object."""
    while isinstance(x, str) and x.lstrip()[:1] in ("{", "[", '"'):
        try:
            y = loads(x)
        except ValueError:
            return x
        if not isinstance(y, (dict, list, str)):
            return x
        x = y
    return x


def reply_of(text: str | None):
    """(complete, body): whether text is one complete JSON document, and the reply object in it or None."""
    if text is None:
        return False, None
    try:
        x = loads(text)
    except ValueError:
        return False, None
    while True:  # each step goes further in
        x = decoded(x)
        if isinstance(x, list):
            x = next((e for e in x if e is not None), None)
        elif isinstance(x, dict) and len(x) == 1 and not x.keys() & {"choices", "usage", "error"}:
            (x,) = x.values()
        else:
            break
    return True, x if isinstance(x, dict) else None


def positioned(x) -> list[tuple[int, object]]:
    """(position, element) of an array in any of its forms; empty for what stands for no array."""
    x = decoded(x)
    if isinstance(x, list):
        return [(i, decoded(e)) for i, e in enumerate(x)]
    if isinstance(x, dict):
        if x and all(k.isascii() and k.isdigit() for k in x):
            return sorted((int(k), decoded(e)) for k, e in x.items()) if len({int(k) for k in x}) == len(x) else [(0, x)]
        return [(0, x)]
    return []


def number(x) -> float | None:
    """A token count by value, however written; NULL if it is none."""
    if x is None or isinstance(x, bool):
        return None
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def reply_fields(text: str | None) -> tuple:
    """(complete, finish_reason, text, prompt_tokens, completion_tokens, reasoning_tokens) of a body."""
    complete, body = reply_of(text)
    body = body or {}
    choices = [c for _, c in positioned(body.get("choices")) if c is not None]
    first = choices[0] if choices and isinstance(choices[0], dict) else {}
    message = decoded(first.get("message"))
    content = message.get("content") if isinstance(message, dict) else None
    if isinstance(content, (list, dict)):
        parts = [p for _, p in positioned(content)]
        content = "".join(t for p in parts if (t := p.get("text") if isinstance(p, dict) else p if isinstance(p, str) else None))
    elif content is not None and not isinstance(content, str):
        content = str(content)
    usage = decoded(body.get("usage"))
    usage = usage if isinstance(usage, dict) else {}
    details = decoded(usage.get("completion_tokens_details"))
    details = details if isinstance(details, dict) else {}
    reason = first.get("finish_reason")
    return (
        complete, None if reason is None else str(reason), content,
        number(usage.get("prompt_tokens")), number(usage.get("completion_tokens")), number(details.get("reasoning_tokens")),
    )
