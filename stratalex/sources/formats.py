"""Symbols of files by format: each reader turns a text into rows with lines, parents and derived fields."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

from . import trees
from .clike import _TODO, Reader, Row, lexed, scanned, snippet

LANGUAGES = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rs": "rust", "py": "python", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "xml": "xml", "arxml": "xml", "xdm": "xml", "dbc": "dbc", "ini": "ini", "cfg": "ini", "md": "markdown", "rst": "rst", "mk": "make", "cmake": "cmake", "html": "xml", "txt": "text",
}
NAMES = {"Makefile": "make", "CMakeLists.txt": "cmake", "Kconfig": "kconfig", "justfile": "just"}


def language_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return NAMES.get(name) or ("kconfig" if name.startswith("Kconfig") else LANGUAGES.get(name.rpartition(".")[2], ""))


class Lines:
    """Offsets of a text's lines, for rows that know only line numbers."""

    def __init__(self, text: str):
        self.text = text
        self.start = [0, *(m.end() for m in re.finditer("\n", text))]

    def end(self, line: int) -> int:
        """Where a line ends, before its line end."""
        return self.start[line] - 1 if line < len(self.start) else len(self.text)

    def until(self, row: Row, last: int) -> None:
        """Moves the end of a row to that of the last line up to ``last`` that is not blank."""
        while last > row.line and not self.text[self.start[last - 1] : self.end(last)].strip():
            last -= 1
        row.end_line, row.end = last, self.end(last)

    def row(self, name: str, kind: str, first: int, last: int, parent: int = -1, **fields: str) -> Row:
        last = max(first, min(last, len(self.start)))
        return Row(name, kind, self.start[first - 1], self.end(last), first, last, parent, fields)


def python(text: str) -> list[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        n = getattr(e, "lineno", 1) or 1
        row = Lines(text).row("", "error", n, n, -1, error_scope="file")
        row.name = snippet(text[row.start : row.end])
        return [row]
    lines, rows = Lines(text), []

    def visit(node: ast.AST, parent: int, owner: str, local: bool) -> None:
        for child in ast.iter_child_nodes(node):
            at, inner = parent, owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                rows.append(lines.row(child.name, "function", child.lineno, child.end_lineno, parent, **function(child, owner)))
                at, inner = len(rows) - 1, ""
                for n in (n for b in child.body for n in ast.walk(b) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))):
                    rows.append(lines.row(n.func.id if isinstance(n.func, ast.Name) else n.func.attr, "call", n.lineno, n.lineno, at))
                visit(child, at, inner, True)
                continue
            if isinstance(child, ast.ClassDef):
                members = sum(isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Assign, ast.AnnAssign)) for c in child.body)
                rows.append(lines.row(child.name, "class", child.lineno, child.end_lineno, parent, member_count=str(members), has_doc="true" if ast.get_docstring(child) else "false"))
                at, inner = len(rows) - 1, child.name
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                for a in child.names:
                    rows.append(lines.row(a.name, "import", child.lineno, child.end_lineno, parent))
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name):
                        kind = "field" if owner else "variable"
                        value = ast.get_source_segment(text, child.value) if child.value else None
                        rows.append(lines.row(t.id, kind, child.lineno, child.end_lineno, parent, scope="local" if local else "file", **({"value": value} if value else {})))
            elif isinstance(child, (ast.If, ast.While)):
                test = ast.unparse(child.test)
                n = 1 + sum(len(b.values) - 1 for b in ast.walk(child.test) if isinstance(b, ast.BoolOp))
                rows.append(lines.row(test, "if" if isinstance(child, ast.If) else "while", child.lineno, child.end_lineno, parent, condition_text=test, condition_tests=str(n)))
            elif isinstance(child, (ast.For, ast.AsyncFor)):
                rows.append(lines.row(ast.unparse(child.target), "for", child.lineno, child.end_lineno, parent, for_style="range"))
            elif isinstance(child, ast.Constant) and isinstance(child.value, (int, float)) and not isinstance(child.value, bool):
                raw = ast.get_source_segment(text, child) or str(child.value)
                index = isinstance(node, ast.Subscript) and child is node.slice and child.value == 0
                negative = isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub)
                at_line = lines.start[child.lineno - 1]
                start = at_line + len(text[at_line : lines.end(child.lineno)].encode()[: child.col_offset].decode())
                fields = {"is_magic": "false" if index else "true", "num_sign": "negative" if negative else "positive", "has_separator": "true" if "_" in raw else "false"}
                rows.append(Row(raw, "number", start, start + len(raw), child.lineno, child.end_lineno, parent, fields))
            visit(child, at, inner, local)

    def function(node, owner: str) -> dict[str, str]:
        args = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
        args = [a for a in args if a not in ("self", "cls")]
        inside = [n for b in node.body for n in ast.walk(b)]
        names = {n.id for n in inside if isinstance(n, ast.Name)}
        calls = [n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in inside if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))]
        f = {
            "param_count": str(len(args)), "lines": str(node.end_lineno - node.lineno + 1), "has_doc": "true" if ast.get_docstring(node) else "false",
            "return_count": str(sum(isinstance(n, ast.Return) for n in inside)), "throw_count": str(sum(isinstance(n, ast.Raise) for n in inside)),
            "string_count": str(sum(isinstance(n, ast.Constant) and isinstance(n.value, str) for n in inside)), "branch_count": str(sum(isinstance(n, (ast.If, ast.For, ast.While)) for n in inside)),
        }
        unused = sorted(set(args) - names)
        if unused:
            f |= {"has_unused_param": "true", "unused_param_count": str(len(unused)), "unused_params": ",".join(unused)}
        if node.name in calls:
            f |= {"is_recursive": "true", "recursion_count": str(calls.count(node.name))}
        if owner:
            f["enclosing_type"] = owner
        if isinstance(node, ast.AsyncFunctionDef):
            f["is_async"] = "true"
        head = text[lines.start[node.lineno - 1] :].split("\n", 1)[0]
        f["signature"] = head.strip().rstrip(":")
        return f

    visit(tree, -1, "", False)
    tags = []
    for token in comment_tokens(text):
        n, at = token.start
        start = lines.start[n - 1] + at
        rows.append(Row(token.string[:60], "comment", start, start + len(token.string), n, n, -1, {"comment_style": "line"}))
        tags += [(n, m[1].upper()) for m in _TODO.finditer(token.string)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].start, -rows[i].end))
    place = {old: new for new, old in enumerate(order)}
    for r in rows:
        r.parent = place.get(r.parent, -1)
    rows = [rows[i] for i in order]
    for r in rows:
        mine = [t for n, t in tags if r.fql_kind == "function" and r.line <= n <= r.end_line]
        if mine:
            r.fields |= {"has_todo": "true", "todo_count": str(len(mine)), "todo_tags": ",".join(sorted(set(mine)))}
    return rows


def comment_tokens(text: str) -> list[tokenize.TokenInfo]:
    """The comments of a Python text; a ``#`` inside a string is none."""
    out = []
    try:
        out += (t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT)
    except (tokenize.TokenError, IndentationError):
        pass
    return out


def folded(language: str, body: str, depth: int) -> list[tuple[int, str]]:
    """(line offset, text) of a body whose blocks nested deeper than ``depth`` are folded; 0 leaves the head."""
    return folded_blocks(body, depth) if language == "python" else folded_braces(body, depth)


def folded_braces(body: str, depth: int) -> list[tuple[int, str]]:
    """Blocks between braces become ``{ }``. Braces in strings, characters and comments are none."""
    marks = {t.at: t.text for t in lexed(body) if t.kind == "op" and t.text in "{}"}
    if not marks and depth == 0:
        return [(0, body.split("\n")[0])]
    out, level, line, started = [""], 0, 0, [0]
    for i, c in enumerate(body):
        mark = marks.get(i)
        if mark == "{":
            level += 1
            if level == depth + 1:
                out[-1] += "{ }"
        if level <= depth:
            if c == "\n":
                out.append("")
                started.append(line + 1)
            else:
                out[-1] += c
        line += c == "\n"
        if mark == "}":
            level = max(0, level - 1)
    return list(zip(started, out))


def folded_blocks(body: str, depth: int) -> list[tuple[int, str]]:
    """Indented blocks become ``...`` behind the line that opens them; lines that go on in a string or in brackets belong to
    their statement."""
    lines = body.split("\n")
    level_of, level, strip = {}, 0, len(lines[0]) - len(lines[0].lstrip())
    plain = "\n".join(x[strip:] if x[:strip].isspace() else x for x in lines)
    try:
        for t in tokenize.generate_tokens(io.StringIO(plain).readline):
            level += (t.type == tokenize.INDENT) - (t.type == tokenize.DEDENT)
            if t.type not in (tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE, tokenize.ENDMARKER):
                for n in range(t.start[0], t.end[0] + 1):
                    level_of.setdefault(n, level)
    except (tokenize.TokenError, IndentationError):
        pass
    out: list[tuple[int, str]] = []
    now = 0
    for i, text in enumerate(lines):
        # a blank line or a comment stands where the next statement does
        after = next((level_of[n] for n in range(i + 1, min(len(lines), i + 50) + 1) if n in level_of), now)
        now = level_of.get(i + 1, after)
        if now <= depth:
            out.append((i, text))
        elif out and not out[-1][1].endswith(" ..."):
            out[-1] = (out[-1][0], out[-1][1] + " ...")
    return out


def xml(text: str) -> list[Row]:
    """Elements, named by their SHORT-NAME child, a name or id attribute, or their tag."""
    import xml.parsers.expat as expat

    lines, rows, stack = Lines(text), [], []
    p = expat.ParserCreate()
    p.buffer_text = True

    def start(tag: str, attrs: dict) -> None:
        named = attrs.get("name") or attrs.get("id")
        rows.append(lines.row(named or tag, "object", p.CurrentLineNumber, p.CurrentLineNumber, stack[-1] if stack else -1, tag=tag, **({"value": attrs["value"]} if "value" in attrs else {})))
        stack.append(len(rows) - 1)

    def end(tag: str) -> None:
        r = rows[stack.pop()]
        r.end_line = p.CurrentLineNumber
        r.end = lines.start[r.end_line] - 1 if r.end_line < len(lines.start) else len(text)

    def chars(data: str) -> None:
        data = data.strip()
        if data and stack:
            row = rows[stack[-1]]
            if row.fields.get("tag") == "SHORT-NAME" and len(stack) > 1:
                rows[stack[-2]].name = data
            row.fields["value"] = data

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    try:
        p.Parse(text, True)
    except expat.ExpatError as e:
        rows.append(lines.row("", "error", max(1, e.lineno), max(1, e.lineno), -1, error_scope="nested" if rows else "root"))
    return rows


def by_lines(rules: list[tuple[str, str]], sections: str | None = None) -> Callable[[str], list[Row]]:
    """A reader from (kind, pattern) rules for single lines; a rule named by ``sections`` holds what follows it."""
    compiled = [(kind, re.compile(pattern)) for kind, pattern in rules]

    def read(text: str) -> list[Row]:
        lines, rows, section = Lines(text), [], -1
        for n, line in enumerate(text.split("\n"), 1):
            for kind, pattern in compiled:
                if m := pattern.match(line):
                    groups = m.groupdict()
                    fields = {k: v for k, v in groups.items() if k != "name" and v}
                    rows.append(lines.row((groups.get("name") or "").strip()[:120], kind, n, n, -1 if kind == sections else section, **fields))
                    if kind == sections:
                        if section >= 0:
                            lines.until(rows[section], n - 1)
                        section = len(rows) - 1
                    break
        if section >= 0:
            lines.until(rows[section], len(lines.start))
        return rows

    return read


def markdown(text: str) -> list[Row]:
    lines, rows, open_ = Lines(text), [], []
    body = text.split("\n")
    n = 1
    while n <= len(body):
        line = body[n - 1]
        if m := re.match(r"^(`{3,}|~{3,})\s*(\S*)", line):
            end = next((k for k in range(n + 1, len(body) + 1) if body[k - 1].startswith(m[1])), len(body))
            rows.append(lines.row(m[2] or "code", "code_block", n, end, open_[-1][1] if open_ else -1))
            n = end
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            level = len(m[1])
            while open_ and open_[-1][0] >= level:
                lines.until(rows[open_.pop()[1]], n - 1)
            rows.append(lines.row(m[2], "section", n, n, open_[-1][1] if open_ else -1, level=str(level)))
            open_.append((level, len(rows) - 1))
            rows.append(lines.row(m[2], "heading", n, n, len(rows) - 1, level=str(level)))
        elif re.match(r"^\s*\|.*\|\s*$", line):
            end = n
            while end < len(body) and re.match(r"^\s*\|.*\|\s*$", body[end]):
                end += 1
            rows.append(lines.row(line.strip()[:60], "table", n, end, open_[-1][1] if open_ else -1))
            n = end
        elif m := re.match(r"^\s*(?:[-*+]|[0-9]+[.)])\s+(.*)", line):
            rows.append(lines.row(m[1][:60], "list_item", n, n, open_[-1][1] if open_ else -1))
        elif line.startswith(">"):
            rows.append(lines.row(line[1:].strip()[:60], "block_quote", n, n, open_[-1][1] if open_ else -1))
        elif line.strip():
            end = n
            while end < len(body) and body[end].strip() and not re.match(r"^(#|>|\||```|~~~|\s*[-*+]\s)", body[end]):
                end += 1
            rows.append(lines.row(line.strip()[:60], "paragraph", n, end, open_[-1][1] if open_ else -1))
            n = end
        n += 1
    for _, at in open_:
        lines.until(rows[at], len(body))
    return rows


def rst(text: str) -> list[Row]:
    """Sections by the order in which their adornments come, with their headings; code blocks with their indented lines."""
    lines, rows, body, levels, open_ = Lines(text), [], text.split("\n"), [], []
    for n in range(1, len(body) + 1):
        line = body[n - 1]
        if m := re.match(r"^(\s*)\.\. (?:code-block|code)::\s*(\S*)", line):
            end = n
            while end < len(body) and (not body[end].strip() or re.match(rf"{m[1]}\s", body[end])):
                end += 1
            rows.append(lines.row(m[2] or "code", "code_block", n, n, open_[-1][1] if open_ else -1))
            lines.until(rows[-1], end)
        rule = body[n] if n < len(body) else ""
        if line.strip() and re.fullmatch(r"([=\-~^\"'#*+])\1+", rule) and len(rule) >= len(line.rstrip()):
            if rule[0] not in levels:
                levels.append(rule[0])
            level = levels.index(rule[0])
            while open_ and open_[-1][0] >= level:
                lines.until(rows[open_.pop()[1]], n - 1)
            rows.append(lines.row(line.strip(), "section", n, n + 1, open_[-1][1] if open_ else -1, adornment=rule[0]))
            open_.append((level, len(rows) - 1))
            rows.append(lines.row(line.strip(), "heading", n, n + 1, len(rows) - 1))
    for _, at in open_:
        lines.until(rows[at], len(body))
    return rows


READERS: dict[str, Callable[[str], list[Row]]] = {
    "c": lambda t: Reader(t, "c").scan(),
    "cpp": lambda t: Reader(t, "cpp").scan(),
    "rust": lambda t: Reader(t, "rust").scan(),
    "python": python,
    "json": trees.json_rows,
    "yaml": trees.yaml_rows,
    "toml": trees.toml_rows,
    "xml": xml,
    "ini": by_lines([("comment", r"^\s*[;#](?P<name>.*)"), ("object", r"^\s*\[(?P<name>[^\]]+)\]"), ("pair", r"^\s*(?P<name>[^=:\s][^=:]*?)\s*[=:]\s*(?P<value>.*)")], "object"),
    "dbc": by_lines([("object", r"^BO_ \d+ (?P<name>\w+)\s*:"), ("field", r"^\s+SG_ (?P<name>\w+)[^:]*:\s*(?P<value>\S+)"), ("enum", r"^VAL_ \d+ (?P<name>\w+)\s+(?P<value>.*);")], "object"),
    "kconfig": by_lines([("comment", r"^\s*#(?P<name>.*)"), ("variable", r"^(?:menu)?config\s+(?P<name>\w+)"), ("section", r"^menu\s+\"(?P<name>[^\"]*)\""), ("import", r"^r?source\s+\"(?P<name>[^\"]*)\"")]),
    "make": by_lines([("comment", r"^\s*#(?P<name>.*)"), ("import", r"^-?include\s+(?P<name>.*)"), ("variable", r"^(?:export\s+)?(?P<name>[\w.]+)\s*[:+?]?=\s*(?P<value>.*)"), ("function", r"^(?P<name>[\w./%-][^:=]*):(?!=)")]),
    "cmake": by_lines([("comment", r"^\s*#(?P<name>.*)"), ("function", r"(?i)^\s*function\s*\(\s*(?P<name>\w+)"), ("macro", r"(?i)^\s*macro\s*\(\s*(?P<name>\w+)"), ("variable", r"(?i)^\s*set\s*\(\s*(?P<name>\w+)\s*(?P<value>[^)]*)"), ("call_statement", r"^\s*(?P<name>\w+)\s*\(")]),
    "just": by_lines([("comment", r"^\s*#(?P<name>.*)"), ("variable", r"^(?P<name>\w+)\s*:=\s*(?P<value>.*)"), ("function", r"^@?(?P<name>[\w-]+)[^:=]*:(?!=)")]),
    "markdown": markdown,
    "rst": rst,
}


def read_pieces(path: str, text: str, frames: list[dict] | None = None, group: int = 0) -> tuple[str, Iterator[list[Row]]]:
    """``read`` in pieces whose parents count from their own first row; together they are the rows of the file."""
    language = language_of(path)
    if language in ("c", "cpp"):
        return language, scanned(text, language, frames=frames, group=group) if frames or group else scanned(text, language)
    return language, iter([read(path, text)[1]])


def read(path: str, text: str) -> tuple[str, list[Row]]:
    """The language and rows of a file; formats without a reader have none."""
    language = language_of(path)
    reader = READERS.get(language)
    return language, reader(text) if reader else []
