"""JSON read as a stream of tokens: wanted values by path, without building a tree.

The reader keeps one frame per open container, so a text may be nested as deeply
as memory allows, and values nobody asked for are checked and passed over.
"""

from __future__ import annotations

import re
from json import dumps
from json.decoder import scanstring

_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|([{}\[\],:])|(-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?(?![\w.+-]))|((?:true|false|null)(?!\w)))', re.A
)
_BLANKS = re.compile(r"[ \t\n\r]*")
_PART = re.compile(r"\[\]|\.\*|\.[^.\[]+")
STRING, SIGN, NUMBER = 1, 2, 3
#: What the grammar allows next: a value; a value or the end of an array; a key; a key or the end of an object; a colon; a comma or the end.
_VALUE, _FIRST, _KEY, _FIRST_KEY, _COLON, _NEXT = range(6)


class Step:
    """A place in the tree of wanted paths: whether it is wanted itself, and the steps below it (by key, of any entry, of any element)."""

    __slots__ = ("path", "wanted", "named", "entry", "element")

    def __init__(self, path: str):
        self.path, self.wanted, self.named, self.entry, self.element = path, False, {}, None, None


def plan_of(paths: frozenset[str]) -> Step:
    """The tree of paths: ``$``, then ``.key``, ``.*`` for any entry of an object used as a map, ``[]`` for any element of an array."""
    root = Step("$")
    for path in sorted(paths):
        at = root
        for part in _PART.findall(path[1:]):
            if part == "[]":
                at.element = at = at.element or Step(at.path + part)
            elif part == ".*":
                at.entry = at = at.entry or Step(at.path + part)
            else:
                at = at.named.setdefault(part[1:], Step(at.path + part))
        at.wanted = True
    return root


class Value:
    """A value of a text: its kind and where it is written."""

    __slots__ = ("kind", "text", "begin", "end")

    def __init__(self, kind: str, text: str, begin: int, end: int):
        self.kind, self.text, self.begin, self.end = kind, text, begin, end

    def __str__(self) -> str:
        """A string without quotes and escapes, anything else as it is written."""
        return _unquoted(self.text, self.begin, self.end) if self.kind == "string" else self.text[self.begin : self.end]


def _unquoted(text: str, begin: int, end: int) -> str:
    if "\\" not in text[begin:end]:
        return text[begin + 1 : end - 1]
    # An escape may name half a pair, which no valid text holds.
    return scanstring(text, begin + 1)[0].encode("utf-16", "surrogatepass").decode("utf-16", "replace")


Found = dict[str, dict[tuple, Value]]


def read_records(text: str | None, plan: Step) -> list[tuple[int, Found]]:
    """(number, wanted values by path and ordinals) of each object that the text is, or of those among the elements of a top-level array.

    Ordinals are the positions and map keys on the way. A text that is null,
    empty or not valid JSON holds nothing. Of a key that an object has twice the last counts.
    """
    if not text:
        return []
    match, at, expect = _TOKEN.match, 0, _VALUE
    records: list[tuple[int, Found]] = []
    found: Found = {}
    outside: list[tuple] = []  # the frames around the open container
    # The open container: whether it is an object, its step, its ordinals, values so far, where it begins, keys met.
    is_object, here, place, count, opened, met = False, None, (), -1, 0, None
    key, whole = "", Step("")
    whole.element = plan
    while m := match(text, at):
        group = m.lastindex
        at, begin = m.end(), m.start(group)
        sign = text[begin]
        if expect == _COLON:
            if sign != ":":
                return []
            expect = _VALUE
            continue
        if (expect == _FIRST_KEY or expect == _KEY) and group == STRING:
            expect = _COLON
            if here is not None and (here.named or here.entry is not None):
                key = _unquoted(text, begin, at)
                if here.entry is not None or key in here.named:
                    if key in met:
                        _forget(found, here, place, key)
                    met.add(key)
            continue
        if group == SIGN and sign in ",:]}":
            if sign == "," and expect == _NEXT and outside:
                expect = _KEY if is_object else _VALUE
                continue
            if sign not in "]}" or not outside or (sign == "}") != is_object or expect != _NEXT and expect != (_FIRST_KEY if is_object else _FIRST):
                return []
            closed, first = here, opened
            if closed is not None and closed.wanted:
                found.setdefault(closed.path, {})[place] = Value("object" if is_object else "array", text, first, at)
            was_object = is_object
            is_object, here, place, count, opened, met = outside.pop()
            if closed is plan and was_object and (here is whole or not outside):
                records.append((count if here is whole else 0, found))
                found = {}
            expect = _NEXT
            continue
        if expect not in (_VALUE, _FIRST):
            return []
        # A value begins.
        count += 1
        if not outside:
            step, ordinals = (whole if sign == "[" else plan), ()
        elif here is None:
            step, ordinals = None, place
        elif here is whole:
            step, ordinals = (plan if sign == "{" else None), ()
        elif not is_object:
            step, ordinals = here.element, (*place, count)
        elif here.entry is not None:
            step, ordinals = here.entry, (*place, key)
        else:
            step, ordinals = here.named.get(key), place
        if group == SIGN:
            outside.append((is_object, here, place, count, opened, met))
            is_object, here, place, count, opened, met = sign == "{", step, ordinals, -1, begin, set()
            expect = _FIRST_KEY if is_object else _FIRST
        else:
            if step is not None and step.wanted:
                kind = "string" if group == STRING else "number" if group == NUMBER else "null" if sign == "n" else "boolean"
                found.setdefault(step.path, {})[ordinals] = Value(kind, text, begin, at)
            expect = _NEXT
    done = expect == _NEXT and not outside and _BLANKS.match(text, at).end() == len(text)
    return records if done else []


def _forget(found: Found, step: Step, place: tuple, key: str) -> None:
    """Drop what an earlier value of the same key of the same object left."""
    below = step.entry or step.named[key]
    if below is step.entry:
        place = (*place, key)
    for path, values in found.items():
        if path == below.path or path.startswith((below.path + ".", below.path + "[")):
            for ordinals in [o for o in values if o[: len(place)] == place]:
                del values[ordinals]


def compact(text: str) -> str | None:
    """A JSON text without blanks between its tokens and with no more escapes than needed, None if it isn't valid."""
    out, at, expect, objects = [], 0, _VALUE, []
    while m := _TOKEN.match(text, at):
        group, at = m.lastindex, m.end()
        token = m[group]
        if expect == _NEXT and not objects:
            return None
        if expect == _COLON:
            if token != ":":
                return None
            expect = _VALUE
        elif expect in (_KEY, _FIRST_KEY) and group == STRING:
            expect = _COLON
        elif token == "," and expect == _NEXT:
            expect = _KEY if objects[-1] else _VALUE
        elif group == SIGN and token in "]}":
            if not objects or (token == "}") != objects[-1] or expect not in (_NEXT, _FIRST_KEY if objects[-1] else _FIRST):
                return None
            objects.pop()
            expect = _NEXT
        elif group == SIGN and token in ",:" or expect not in (_VALUE, _FIRST):
            return None
        elif group == SIGN:
            objects.append(token == "{")
            expect = _FIRST_KEY if token == "{" else _FIRST
        else:
            expect = _NEXT
        out.append(dumps(_unquoted(text, m.start(group), at), ensure_ascii=False) if group == STRING and "\\" in token else token)
    return "".join(out) if expect == _NEXT and not objects and _BLANKS.match(text, at).end() == len(text) else None
