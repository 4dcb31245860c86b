"""Readers of JSON, YAML and TOML: every member and element as a row whose span is its text, from its key to its value's end."""

from __future__ import annotations

import json
import re
from bisect import bisect_right

from .clike import Row

_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\s\[\]{}:,"]+', re.S)


class Tree:
    """Rows of one text in document order, with key paths."""

    def __init__(self, text: str):
        self.text, self.rows = text, []
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def open(self, name: str, kind: str, start: int, parent: int) -> int:
        above = self.rows[parent].fields["key_path"] + "." if parent >= 0 else ""
        self.rows.append(Row(name, kind, start, start, self.line(start), self.line(start), parent, {"key_path": above + name}))
        return len(self.rows) - 1

    def close(self, row: int, end: int) -> None:
        r = self.rows[row]
        r.end, r.end_line = end, self.line(max(r.start, end - 1))

    def leaf(self, name: str, start: int, end: int, parent: int, value: object) -> int:
        row = self.open(name, "pair", start, parent)
        self.rows[row].fields["value"] = value if isinstance(value, str) else json.dumps(value, default=str)
        self.close(row, end)
        return row

    def broken(self, scope: str, line: int | None = None) -> list[Row]:
        """An error row: of the whole text, or of one line."""
        if line is None:
            return [Row("", "error", 0, len(self.text), 1, len(self.starts), -1, {"error_scope": scope})]
        line = max(1, min(line, len(self.starts)))
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.text)
        return [Row("", "error", self.starts[line - 1], end, line, line, -1, {"error_scope": scope})]


def json_rows(text: str) -> list[Row]:
    """One pass over the tokens with a stack of open objects and arrays; the outermost one has no row."""
    t = Tree(text)
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return t.broken("root")
    stack: list[list] = []  # row, whether an array, next index, key, where the key starts
    for m in _JSON.finditer(text):
        token, top = m.group(), stack[-1] if stack else None
        if token == ":":
            continue
        if token == ",":
            top[3] = None
            continue
        if token in "]}":
            if stack.pop()[0] >= 0:
                t.close(top[0], m.end())
            continue
        if top and not top[1] and top[3] is None:  # a key
            top[3], top[4] = json.loads(token), m.start()
            continue
        start = m.start()
        if top and top[1]:
            top[3], top[2] = str(top[2]), top[2] + 1
        elif top:
            start = top[4]
        if token in "[{":
            row = t.open(top[3], "object" if token == "{" else "array", start, top[0]) if top else -1
            stack.append([row, token == "[", 0, None, 0])
        elif top:
            t.leaf(top[3], start, m.end(), top[0], json.loads(token))
        if top and top[1]:
            top[3] = None
    return t.rows


def yaml_rows(text: str) -> list[Row]:
    """By the marks of the parser's events. A block ends where its last value does: the mark of its end lies at the next
    token, after comments and blank lines. An alias is a pair whose value is its name."""
    import yaml

    t = Tree(text)
    made = yaml.SafeLoader("")
    try:
        yaml.safe_load(text)
        events = iter([*yaml.parse(text, yaml.SafeLoader)])
    except (yaml.YAMLError, ValueError, RecursionError, TypeError):
        return t.broken("root")

    def scalar(event) -> object:
        tag = event.tag if event.tag not in (None, "!") else made.resolve(yaml.ScalarNode, event.value, event.implicit)
        return made.construct_object(yaml.ScalarNode(tag, event.value, event.start_mark, event.end_mark))

    def walk(event, name: str, start: int, parent: int, top: bool = False) -> int:
        end = event.end_mark.index
        if isinstance(event, yaml.AliasEvent):
            t.leaf(name, start, end, parent, f"*{event.anchor}")
            return end
        if isinstance(event, yaml.ScalarEvent):
            if not top:
                end = max(start, len(text[:end].rstrip())) if event.style in ("|", ">") else end
                t.leaf(name, start, end, parent, scalar(event))
            return end
        mapping = isinstance(event, yaml.MappingStartEvent)
        row = -1 if top else t.open(name, "object" if mapping else "array", start, parent)
        n = 0
        while not isinstance(inner := next(events), (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
            at, key = inner.start_mark.index, str(n)
            if mapping:
                key = inner.value if isinstance(inner, yaml.ScalarEvent) else text[at : skipped(inner)]
                inner = next(events)
            end, n = walk(inner, key, at, row), n + 1
        end = inner.end_mark.index if event.flow_style else end
        if row >= 0:
            t.close(row, end)
        return end

    def skipped(event) -> int:
        """The end of a key that is no scalar."""
        depth, last = 0, event
        while True:
            depth += isinstance(last, (yaml.MappingStartEvent, yaml.SequenceStartEvent)) - isinstance(last, (yaml.MappingEndEvent, yaml.SequenceEndEvent))
            if not depth:
                return last.end_mark.index
            last = next(events)

    for event in events:
        if isinstance(event, (yaml.MappingStartEvent, yaml.SequenceStartEvent, yaml.ScalarEvent)):
            walk(event, "", 0, -1, True)
    made.dispose()
    return t.rows


_SPACE = re.compile(r"(?:\s|#[^\n]*)*")
_KEY = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([A-Za-z0-9_-]+))\s*""")
_STRING = re.compile(r'''"""(?:[^\\]|\\.)*?"{3,5}|\'\'\'.*?\'{3,5}|"(?:[^"\\\n]|\\.)*"|'[^'\n]*\'''', re.S)
_BARE = re.compile(r"[^\s,\]}#]+(?: [0-9][^\s,\]}#]*)?")


def toml_rows(text: str) -> list[Row]:
    """Statement by statement: headers open tables, which end with their last statement; values are gone into by brackets."""
    import tomllib

    t = Tree(text)
    try:
        whole = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return t.broken("root")
    tables: dict[tuple[str, ...], int] = {}
    counts: dict[tuple[str, ...], int] = {}
    dotted: dict[tuple[int, str], int] = {}

    def keys(at: int) -> tuple[list[str], int]:
        out = []
        while m := _KEY.match(text, at):
            out.append(json.loads(f'"{m[1]}"') if m[1] is not None else m[2] if m[2] is not None else m[3])
            at = m.end()
            if text[at : at + 1] != ".":
                break
            at += 1
        return out, at

    def reach(path: tuple[str, ...], start: int, kind: str = "object") -> int:
        """The row of a table, made with those above it if it is new."""
        if not path:
            return -1
        if path not in tables:
            tables[path] = t.open(path[-1], kind, start, reach(path[:-1], start))
        return tables[path]

    def grow(row: int, end: int) -> None:
        while row >= 0:
            t.close(row, max(end, t.rows[row].end))
            row = t.rows[row].parent

    def value(at: int, name: str, start: int, parent: int, data: object) -> int:
        if text[at] == "[":
            row, i, at = t.open(name, "array", start, parent), 0, _SPACE.match(text, at + 1).end()
            while text[at] != "]":
                at = _SPACE.match(text, value(at, str(i), at, row, data[i])).end()
                i += 1
                at = _SPACE.match(text, at + 1).end() if text[at] == "," else at
        elif text[at] == "{":
            row, at = t.open(name, "object", start, parent), _SPACE.match(text, at + 1).end()
            while text[at] != "}":
                names, eq = keys(at)
                inner, inside = data, row
                for n in names[:-1]:
                    inner, inside = inner[n], t.open(n, "object", at, inside)
                end = value(_SPACE.match(text, eq + 1).end(), names[-1], at, inside, inner[names[-1]])
                while inside != row:
                    t.close(inside, end)
                    inside = t.rows[inside].parent
                at = _SPACE.match(text, end).end()
                at = _SPACE.match(text, at + 1).end() if text[at] == "," else at
        else:
            end = (_STRING.match(text, at) or _BARE.match(text, at)).end()
            t.leaf(name, start, end, parent, data)
            return end
        t.close(row, at + 1)
        return at + 1

    at, here, data = _SPACE.match(text, 0).end(), -1, whole
    while at < len(text):
        start = at
        if text[at] == "[":
            many = text[at : at + 2] == "[["
            names, at = keys(at + 1 + many)
            at += 1 + many
            data, path = whole, ()
            for i, n in enumerate(names):
                path, data = (*path, n), data[n]
                if isinstance(data, list):
                    last = many and i == len(names) - 1
                    counts[path] = k = counts.get(path, -1) + last
                    reach(path, start, "array")
                    path, data = (*path, str(k)), data[k]
            here = reach(path, start)
            grow(here, at)
        else:
            names, at = keys(at)
            inside, inner = here, data
            for n in names[:-1]:
                if (inside, n) not in dotted:
                    dotted[inside, n] = t.open(n, "object", start, inside)
                inside, inner = dotted[inside, n], inner[n]
            at = value(_SPACE.match(text, at + 1).end(), names[-1], start, inside, inner[names[-1]])
            grow(inside, at)
        at = _SPACE.match(text, at).end()
    return t.rows


def json_member_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The span of a JSON member or element with the comma that goes with it, so that what is left still parses."""
    if m := re.compile(r"\s*,\s*").match(text, end):
        return start, m.end()
    before = re.compile(r",\s*\Z").search(text[:start])
    return (before.start() if before else start), end
