"""Symbols of brace languages (C, C++, Rust) from a hand-written lexer, and the derived fields of their functions.

There is no grammar here: declarations are recognised by the shape of token runs between braces, semicolons and
parentheses. That covers ordinary code; what a macro hides from the lexer stays hidden.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

# a token behind the blanks before it; what begins most tokens is tried first, and an indented preprocessor line keeps its blanks
_LEX = re.compile(
    r"""(?:\n[ \t]*+(?!\#)|\n|[ \t]++(?!\#))*+(?:
    ([(){}\[\];,])
    |([A-KM-QSTV-Za-qstv-z_$][A-Za-z0-9_$]*!?)
    |(//[^\n]*|/\*.*?\*/)
    |(^[ \t]*\#(?:[^\n\\]|\\\n|\\.)*)
    |([LuUR]?"(?:[^"\\\n]|\\.)*"|r\#*"[^"]*"\#*)
    |('(?:[^'\\\n]|\\.)+')
    |((?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|(?:[0-9][0-9_']*\.?[0-9_']*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[A-Za-z0-9_]*)
    |([LuURr][A-Za-z0-9_$]*!?)
    |(<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||::|=>|[-+*/%&|^=!<>]=|<<|>>|[^\s\w]))""",
    re.X | re.S | re.M,
)
_KINDS = ("", "op", "name", "comment", "pre", "string", "char", "number", "name", "op")  # of the groups of ``_LEX``
_CONTROL = {"if", "while", "for", "switch", "do", "match", "loop", "else", "return", "sizeof", "catch", "case"}
_TYPES = {"struct": "struct", "class": "class", "union": "struct", "enum": "enum", "trait": "interface", "impl": "class", "namespace": "namespace", "mod": "namespace"}
# fixed values: the words that modify a declaration
_MODIFIERS = ("const", "static", "inline", "extern", "volatile", "virtual", "mutable", "constexpr", "explicit", "override", "final", "unsafe", "async", "pub", "mut")
_MODIFIED = frozenset(_MODIFIERS)
_COMPOUND = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
_CAST = re.compile(r"\b(static|dynamic|const|reinterpret)_cast\s*<([^<>]*)>")
# fixed values: the grammar's names of type nodes, and who sees a member by default
_OWNERS = {"struct": "struct_specifier", "class": "class_specifier", "union": "union_specifier", "enum": "enum_specifier"}
_RUST_OWNERS = {"struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "union": "union_item"}
_SEEN = {"cpp": {"class": "private", "struct": "public"}, "rust": {"struct": "private", "enum": "public"}}
_SAFETY = {"static": "safe", "dynamic": "safe", "const": "moderate", "reinterpret": "unsafe"}
_TODO = re.compile(r"(?<![A-Za-z0-9])(TODO|FIXME|HACK|XXX)(?![A-Za-z0-9])", re.I)
_PASS = re.compile(r"(?:/\*|//)\s*(?:fall[ -]?through|fallthru)\b|\[\[fallthrough\]\]", re.I)


# how many tokens are held before a text is cut behind a function
PIECE = 50_000
_PAIRS = {"(": ")", "{": "}", "[": "]"}
_BRACKETS = frozenset("(){}[]")
_OPENS, _SHUTS = frozenset("(<[{"), frozenset(")>]}")
_DECLARED = frozenset(("=", ";", "[", ",", ":"))  # what stands behind a declared name
_PLAIN_OPS = frozenset((")", "{", "}", "[", "]", ";", ",", ".", "->", "::", "=", "==", "!=", "<", ">", "<=", ">=", "&&", "||"))  # these make no rows
_APART = frozenset(("&&", "||", "and", "or", "==", "!=", "<", ">", "<=", ">=", "!", "(", ")", "=", ";"))  # these part the operands of a condition
_BRANCHES = frozenset(("if", "while", "for", "switch", "do", "match"))


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int
    end: int


@dataclass(slots=True)
class Row:
    name: str
    fql_kind: str
    start: int
    end: int
    line: int
    end_line: int
    parent: int = -1
    fields: dict[str, str] = field(default_factory=dict)


def line_starts(text: str) -> Sequence[int]:
    return array("q", [0]) + array("q", (m.end() for m in re.finditer("\n", text)))


def tokens(text: str, starts: Sequence[int]) -> Iterator[Token]:
    line, after, last = 0, 0, len(starts)  # where the line behind the one at hand begins
    for m in _LEX.finditer(text):
        group = m.lastindex
        at, end = m.span(group)
        while after <= at:
            line += 1
            after = starts[line] if line < last else len(text) + 1
        yield Token(_KINDS[group], m[group], at, line, end)


def lexed(text: str) -> list[Token]:
    return [*tokens(text, line_starts(text))]


def scanned(text: str, language: str, piece: int = PIECE, frames: list[dict] | None = None, group: int = 0) -> Iterator[list[Row]]:
    """The rows of a text, piece by piece: together they are what one ``Reader`` finds in the whole, each piece's parents
    counted from its own first row. A C or C++ text is cut behind a function of its top level, where no bracket is open and
    nothing before bears on what follows but the preprocessor's conditions; so a long text takes memory for a piece."""
    starts = line_starts(text)
    held: list[Token] = []
    stack: list[str] = []
    least, frames = piece, frames or []
    for t in tokens(text, starts):
        held.append(t)
        mark = t.text
        if mark not in _BRACKETS or language == "rust":
            continue
        if mark in _PAIRS:
            stack.append(_PAIRS[mark])
        else:
            at = len(stack) - 1 if stack and stack[-1] == mark else next((k for k in range(len(stack) - 1, -1, -1) if stack[k] == mark), None)
            if at is not None:
                del stack[at:]
            if mark == "}" and not stack and len(held) >= least:
                reader = Reader(text, language, held, starts, frames, group)
                rows = reader.scan()
                if reader.tail == len(reader.code) - 1:
                    yield rows
                    held, least, frames, group = [], piece, reader.frames, reader.group
                else:
                    least = 2 * len(held)
    yield Reader(text, language, held, starts, frames, group).scan()


# one bracket or preprocessor line behind whatever else stands there, by the alternatives of ``_LEX``
_CUT = re.compile(
    r"""(?:[A-KM-QSTV-Za-qstv-z_$][A-Za-z0-9_$]*+
    |[ \t]++(?!\#)
    |[\n;,=&|*+<>:?%~^!-]
    |(?>//[^\n]*|/\*.*?\*/)
    |(?!^[ \t]*\#)(?:
    (?>[LuUR]?"(?:[^"\\\n]|\\.)*"|r\#*"[^"]*"\#*)
    |(?>'(?:[^'\\\n]|\\.)+')
    |(?>(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|(?:[0-9][0-9_']*\.?[0-9_']*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[A-Za-z0-9_]*)
    |(?>[A-Za-z_$][A-Za-z0-9_$]*!?(?<!=))
    |[^(){}\[\]]))*+
    (?:(?P<pre>^[ \t]*\#(?:[^\n\\]|\\\n|\\.)*)|(?P<at>[(){}\[\]]))""",
    re.X | re.S | re.M,
)
_ASIDE = re.compile(r"""(?P<gone>//[^\n]*|/\*.*?\*/|^[ \t]*\#(?:[^\n\\]|\\\n|\\.)*)|[LuUR]?"(?:[^"\\\n]|\\.)*"|r\#*"[^"]*"\#*|'(?:[^'\\\n]|\\.)+'""", re.S | re.M)
_NOTED = re.compile(r"(?>\s*/\*.*?\*/)*+", re.S | re.A)
_PLAIN = re.compile(r"[\w\s*&]*?\b([A-Za-z_][A-Za-z0-9_]*)\s*\([\w\s*&,]*\)\s*", re.A)


@dataclass(slots=True)
class Part:
    """The characters of a text from ``start`` to ``end``, behind ``line`` line ends and under the conditions ``frames``."""

    start: int
    end: int
    line: int
    frames: list[dict]
    group: int


def parts(text: str, least: int) -> Iterator[Part]:
    """A C or C++ text in parts of ``least`` characters and more that can be read apart: each but the last ends with the line
    that the last brace of a plain function of the top level stands in. A walk over brackets and preprocessor lines finds them; what
    it is not sure of stays together until the next semicolon of the top level."""
    start, line, frames, group = 0, 0, [], 0
    before: tuple[list[dict], int] = [], 0
    stack: list[str] = []
    item, sure = 0, True  # where the item at hand begins, and whether that is known
    brace = 0
    place = 0
    while m := _CUT.match(text, place):
        place = m.end()
        if m["pre"] is not None:
            group = conditions(m["pre"], frames, group) or group
            continue
        at = m.start("at")
        mark = text[at]
        if mark in _PAIRS:
            if not stack and mark == "{":
                brace = at
            stack.append(_PAIRS[mark])
            continue
        if not stack or stack.pop() != mark:
            break  # a bracket without a partner: the rest is one part
        if stack or mark != "}":
            continue
        head = text[_NOTED.match(text, item, brace).end() : brace]
        if not _PLAIN.fullmatch(head):
            head = _ASIDE.sub(lambda x: " " if x["gone"] is not None else '"', text[item:brace])
        if ";" in head:
            head, sure = head[head.rindex(";") + 1 :], True
        plain = _PLAIN.fullmatch(head)
        words = set(re.findall(r"\w+", head))
        sure = sure and plain is not None and plain[1] not in _CONTROL and not words & _TYPES.keys()
        item = at + 1
        if not sure or item - start < least:
            continue
        stop = text.find("\n", item) + 1
        if not stop or text[item:stop].strip():
            continue
        yield Part(start, stop, line, *before)
        line += text.count("\n", start, stop)
        start, before = stop, ([*frames], group)
    yield Part(start, len(text), line, *before)


def conditions(line: str, frames: list[dict], group: int) -> int | None:
    """Opens, turns or closes the conditions ``frames`` as a preprocessor line says; answers with the number of groups so far, or
    nothing if the line is no condition."""
    m = re.match(r"\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b\s*(.*)", line, re.S)
    if not m:
        return None
    word, cond = m[1], " ".join(re.sub(r"//.*|/\*.*?\*/", "", m[2]).split())
    cond = f"defined({cond})" if word == "ifdef" else f"!defined({cond})" if word == "ifndef" else cond
    if word in ("if", "ifdef", "ifndef"):
        group += 1
        frames.append({"cond": cond, "past": [], "group": group, "branch": 0})
    elif word in ("elif", "else") and frames:
        top = frames[-1]
        frames[-1] = {"cond": " && ".join([*(negated(c) for c in [*top["past"], top["cond"]]), *([cond] if word == "elif" else [])]), "past": [*top["past"], top["own"] if "own" in top else top["cond"]],
                      "own": cond, "group": top["group"], "branch": top["branch"] + 1}
    elif word == "endif" and frames:
        frames.pop()
    return group


class Reader:
    """Reads ``text``, or the part of it that ``held`` are the tokens of, under the conditions ``frames`` that are open there."""

    def __init__(self, text: str, language: str, held: list[Token] | None = None, starts: Sequence[int] | None = None, frames: list[dict] | None = None, group: int = 0):
        self.text, self.language = text, language
        self.starts = line_starts(text) if starts is None else starts
        self.all = [*tokens(text, self.starts)] if held is None else held
        self.frames, self.group = [*(frames or ())], group
        self.tail = -1  # where the last function of the top level ends
        self.code = [t for t in self.all if t.kind not in ("comment", "pre")]
        self.texts = [t.text for t in self.code]
        self.ends = [t.end for t in self.all]
        self.notes = [t for t in self.all if t.kind == "comment"]
        self.pres = [t for t in self.all if t.kind == "pre"]
        self.noted = [t.at for t in self.notes]
        self.rows: list[Row] = []
        self.word: dict[int, str] = {}
        self.access: dict[int, str] = {}
        self.close = self.matched()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def matched(self) -> dict[int, int]:
        """Places of opening brackets with those of the closing ones; ``odd`` collects what has no partner."""
        pairs, out, stack, texts = _PAIRS, {}, [], self.texts
        self.odd: list[int] = []
        for i, t in enumerate(texts):
            if t not in _BRACKETS:
                continue
            if t in pairs:
                stack.append(i)
            else:
                if stack and pairs[texts[stack[-1]]] == t:
                    out[stack.pop()] = i
                    continue
                at = next((k for k in range(len(stack) - 1, -1, -1) if pairs[texts[stack[k]]] == t), None)
                if at is None:
                    self.odd.append(i)
                else:
                    self.odd += stack[at + 1 :]
                    out[stack[at]] = i
                    del stack[at:]
        self.odd += stack
        return out

    def errors(self) -> None:
        """A row for each bracket without a partner: from an opening one to the end of its line, else the bracket."""
        for i in self.odd:
            t = self.code[i]
            end = self.text.find("\n", t.at) if t.text in "({[" else t.end
            end = len(self.text) if end < 0 else end
            owner = min((k for k, r in enumerate(self.rows) if r.name and r.start <= t.at and end <= r.end), key=lambda k: self.rows[k].end - self.rows[k].start, default=-1)
            self.rows.append(Row(snippet(self.text[t.at : end]), "error", t.at, end, t.line, t.line, owner, {"error_scope": "nested" if owner >= 0 else "file"}))

    def add(self, name: str, kind: str, a: int, b: int, parent: int = -1, **fields: str) -> int:
        """A row from code token ``a`` to ``b``."""
        x, y = self.code[a], self.code[min(b, len(self.code) - 1)]
        last = y.line if y.kind not in ("string", "char") and y.at >= x.at else self.line(max(x.at, y.end - 1))
        self.rows.append(Row(name, kind, x.at, y.end, x.line, last, parent, fields))
        return len(self.rows) - 1

    def scan(self) -> list[Row]:
        self.items(0, len(self.code), -1, "file")
        self.preprocessor()
        self.comments()
        self.guards()
        self.errors()
        order = sorted(range(len(self.rows)), key=lambda i: (self.rows[i].start, -self.rows[i].end))
        place = {old: new for new, old in enumerate(order)}
        for r in self.rows:
            r.parent = place.get(r.parent, -1)
        return [self.rows[i] for i in order]

    def items(self, a: int, b: int, parent: int, where: str) -> None:
        """Declarations between code tokens a and b of a file, namespace or type."""
        code, start = self.code, a
        i = a
        while i < b:
            t = code[i].text if code[i].kind in ("op", "name") else ""
            if t == ";" or (t == "," and where in ("struct", "enum")):
                self.simple(start, i, parent, where)
                start = i + 1
            elif t == "}":
                start = i + 1
            elif t == ":" and i == start + 1 and code[start].text in ("public", "private", "protected"):
                if parent in self.word:
                    self.access[parent] = code[start].text
                start = i + 1
            elif t in ("(", "[") and i in self.close:
                i = self.close[i]
            elif t == "{" and i in self.close:
                end = self.close[i]
                done = self.braced(start, i, end, parent, where)
                i = end
                if done:
                    start = end + 1
            i += 1
        if (where == "enum" or (where == "struct" and self.language == "rust")) and start < b:
            self.simple(start, b, parent, where)

    def braced(self, start: int, brace: int, end: int, parent: int, where: str) -> bool:
        """What the braces after ``start`` belong to; False if they are part of an expression."""
        code = self.code
        head = code[start:brace]
        words = [t.text for t in head]
        if not head:
            self.items(brace + 1, end, parent, where)
            return True
        kind = next((w for w in words if w in _TYPES), None)
        opened = next((start + k for k, t in enumerate(head) if t.text == "(" and k), None)
        if "=" in words and kind is None and (opened is None or words.index("=") < opened - start):
            return False
        if kind and (opened is None or words.index(kind) < opened - start) and not ("fn" in words):
            k = words.index(kind)
            base = words.index(":") if ":" in words else len(words)
            names = [w for w, t in zip(words[k + 1 : base], head[k + 1 : base]) if t.kind == "name" and w not in ("final", "class")]
            name = (names[-1] if "for" in words and kind == "impl" else names[0]) if names else ""
            row = self.add(name, _TYPES[kind], start, end, parent)
            self.definition(row, start, words)
            self.word[row] = kind
            if seen := _SEEN.get(self.language, {}).get(kind):
                self.access[row] = seen
            self.items(brace + 1, end, row, "enum" if kind == "enum" else "struct" if _TYPES[kind] in ("struct", "class", "interface") else "file")
            members = sum(r.parent == row and r.fql_kind in ("field", "function") for r in self.rows)
            self.rows[row].fields["member_count"] = str(members)
            return kind not in ("struct", "union", "enum") or self.language == "rust" or self.follows(end)
        if words[0] == "extern" and len(words) == 2:
            self.items(brace + 1, end, parent, where)
            return True
        if opened is not None and code[opened - 1].kind == "name" and code[opened - 1].text not in _CONTROL:
            self.function(start, opened, brace, end, parent, where)
            if parent < 0:
                self.tail = end
            return True
        if words[0] in ("macro_rules!",):
            self.add(words[1] if len(words) > 1 else "", "macro", start, end, parent)
            return True
        return True

    def follows(self, end: int) -> bool:
        return end + 1 >= len(self.code) or self.code[end + 1].text == ";"

    def definition(self, row: int, start: int, words: list[str]) -> None:
        f = self.rows[row].fields
        for w in () if _MODIFIED.isdisjoint(words) else _MODIFIERS:
            if w in words:
                f[modifier(w)] = "true"
        k = bisect_right(self.ends, self.code[start].at) - 1
        before = self.all[k] if k >= 0 else None
        f["has_doc"] = "true" if before and before.kind == "comment" and self.line(before.end) >= self.code[start].line - 1 else "false"

    def simple(self, a: int, b: int, parent: int, where: str) -> None:
        """A statement that ends without braces."""
        code = self.code[a:b]
        if not code:
            return
        words = [t.text for t in code]
        self.outside(a, b, parent)
        if words[0] in ("use", "import", "using") and "=" not in words:
            self.add("".join(words[1:]), "import", a, b, parent)
        elif words[0] in ("typedef", "type") or (words[0] == "using" and "=" in words):
            names = [t.text for t in code if t.kind == "name"]
            self.add(names[1] if words[0] != "typedef" and len(names) > 1 else names[-1], "type_alias", a, b, parent)
        elif where == "enum":
            if code[0].kind == "name":
                self.add(words[0], "field", a, b - 1, parent, member_kind="enumerator")
        else:
            marks = [words.index(m) for m in ("=", *([":"] if self.language == "rust" else [])) if m in words]
            cut = min(marks, default=len(words))
            names = [t for t in code[:cut] if t.kind == "name" and t.text not in _MODIFIERS]
            if "(" in words[:cut]:
                k = words.index("(")
                if k and code[k - 1].kind == "name":
                    if where == "struct":
                        self.add(code[k - 1].text, "field", a, b, parent, member_kind="method", **self.member(parent, code[k - 1].text))
                    elif where == "file" and self.language != "rust" and words[0] not in ("return", "template", "friend") and any(t.kind == "name" for t in code[: k - 1]):
                        self.add(code[k - 1].text, "variable", a, b, parent, **self.declared("file", words[: k - 1], "function"))
                return
            if names and (len(names) > 1 or self.language == "rust") and words[0] not in ("return", "goto", "break", "continue", "friend", "template"):
                pick = names[-1]
                row = self.add(pick.text, "field" if where == "struct" else "variable", a, b, parent, scope="file")
                f = self.rows[row].fields
                if where == "struct":
                    f.pop("scope")
                    f |= {"member_kind": "field", **self.member(parent)}
                else:
                    f |= self.declared("file", words[:cut], "variable")
                if self.language == "rust":
                    f["type"] = "".join(words[cut + 1 : words.index("=") if "=" in words else len(words)]).rstrip(",;")
                else:
                    f["type"] = " ".join(t.text for t in code[:cut] if t is not pick and t.text not in ("static", "extern"))
                if "=" in words:
                    f["value"] = self.text[code[words.index("=")].end : code[-1].end].strip()
                for w in _MODIFIERS:
                    if w in words:
                        f[modifier(w)] = "true"

    def outside(self, a: int, b: int, parent: int) -> None:
        """Numbers and calls of a declaration outside functions: a call stands behind ``=``, or is all there is."""
        code, value = self.code, False
        for i in range(a, min(b, len(code) - 1)):
            value |= code[i].text in ("=", "{")
            if code[i].kind == "number":
                self.number(i, parent)
            elif code[i].kind == "name" and code[i + 1].text == "(" and i + 1 in self.close and code[i].text not in _CONTROL and (value or (i == a and self.close[i + 1] >= b - 1)):
                called = self.arguments(i + 1)
                self.add(code[i].text.rstrip("!"), "macro_call" if code[i].text.endswith("!") else "call", i, self.close[i + 1], parent, arguments="\x1f".join(called), argument_count=str(len(called)))

    def member(self, parent: int, method: str = "") -> dict[str, str]:
        """What a field or a declared method says about the type around it."""
        if parent < 0:
            return {}
        owner, out = self.rows[parent].name, {}
        if kind := (_RUST_OWNERS if self.language == "rust" else _OWNERS).get(self.word.get(parent, "")):
            out["owner_kind"] = kind
        if parent in self.access:
            out["visibility"] = self.access[parent]
        if method:
            out["enclosing_type"] = owner
            if owner:
                out["body_symbol"] = f"{owner}::{method}"
        return out

    def declared(self, scope: str, words: list[str], binding: str) -> dict[str, str]:
        out = {"scope": scope, "binding_kind": binding}
        if storage := next((w for w in words if w in _MODIFIERS), None):
            out["storage"] = storage
        if scope == "file" and "static" not in words:
            out["is_exported"] = "true"
        return out

    def first_statement(self, brace: int, end: int) -> str:
        i = brace + 1
        while i < end and self.code[i].text != ";":
            if self.code[i].text in ("(", "[", "{") and i in self.close:
                block, i = self.code[i].text == "{", self.close[i]
                if block:
                    break
            i += 1
        return self.text[self.code[brace + 1].at : self.code[min(i, end - 1)].end] if end > brace + 1 else ""

    def function(self, start: int, opened: int, brace: int, end: int, parent: int, where: str) -> None:
        code = self.code
        name = code[opened - 1].text
        k = opened - 1
        owner = ""
        while k >= 2 and code[k - 1].text in ("::", "~"):
            if code[k - 1].text == "::":
                owner = owner or code[k - 2].text
                k -= 2
            else:
                name, k = "~" + name, k - 1
        words = [t.text for t in code[start:brace]]
        row = self.add(name, "function", start, end, parent)
        self.definition(row, start, words)
        f = self.rows[row].fields
        if where == "struct" and parent >= 0:
            owner = self.rows[parent].name
        if owner:
            f["enclosing_type"] = owner
        if "pub" in words:
            f["is_exported"] = "true"
        if first := self.first_statement(brace, end):
            f["first_body_statement_fingerprint"] = content_hash(first)
        params = self.params(opened)
        body = code[brace + 1 : end]
        f["lines"] = str(self.line(code[end].end - 1) - code[start].line + 1)
        f["param_count"] = str(len(params))
        kinds = [t.kind for t in body]
        names = Counter([x for x, kind in zip(self.texts[brace + 1 : end], kinds) if kind == "name"])
        for key, word in (("return_count", "return"), ("goto_count", "goto"), ("throw_count", "throw")):
            f[key] = str(names[word])
        f["string_count"] = str(kinds.count("string"))
        f["signature"] = " ".join(self.text[code[start].at : code[brace].at].split())
        f["body_start"] = str(code[brace].at)
        self.flow(row, brace, end)
        if names["switch"]:
            self.fallthrough(row, brace, end)
        self.data_flow(row, params, brace, end, names)
        self.content(row, brace, end)

    def params(self, opened: int) -> list[str]:
        out, part, depth = [], [], 0
        for t in self.code[opened + 1 : self.close.get(opened, opened)]:
            if t.text in _OPENS:
                depth += 1
            elif t.text in _SHUTS:
                depth -= 1
            if t.text == "," and depth == 0:
                out.append(part)
                part = []
            else:
                part.append(t)
        out.append(part)
        names = []
        for part in out:
            words = [t for t in part if t.kind == "name"]
            if not words or (len(words) == 1 and words[0].text in ("void", "self")) or "self" in [w.text for w in words]:
                continue
            if self.language == "rust":
                names.append(next(t.text for t in words if t.text != "mut"))
            else:
                cut = next((k for k, t in enumerate(part) if t.text == "="), len(part))
                names.append([t for t in part[:cut] if t.kind == "name"][-1].text)
        return names

    def flow(self, row: int, brace: int, end: int) -> None:
        """Rows of control flow inside a function, and its maxima."""
        code, seen = self.code, {}
        tests, parens, calls, branches = 0, 0, {}, 0
        places = []
        texts = self.texts
        for i in [i for i, x in enumerate(texts[brace + 1 : end], brace + 1) if x in _BRANCHES]:
            t = code[i]
            kind = "switch" if t.text == "match" else t.text
            branches += 1
            opened = i + 1
            if kind == "do":
                self.add("do", "do", i, self.close.get(opened, i), row)
                continue
            if code[opened].text == "(" and opened in self.close:
                a, b = opened + 1, self.close[opened]
            else:
                a = opened
                b = next((k for k in range(a, end) if code[k].text == "{"), a)
            text = self.text[code[a].at : code[b].at].strip() if b > a else ""
            body = b + 1 if code[b].text == ")" else b
            stop = self.close.get(body, b) if body < len(code) and code[body].text == "{" else b
            words = texts[a:b]
            bones = skeleton(words)
            at = self.add(bones or text, kind, i, stop, row)
            f = self.rows[at].fields
            n = 1 + sum(map(words.count, ("&&", "||", "and", "or")))
            depth = nesting(words) if "(" in words else 0
            tests, parens = max(tests, n), max(parens, depth)
            f |= {"condition_text": text, "condition_tests": str(n), "paren_depth": str(depth), "enclosing_fn": self.rows[row].name}
            if "=" in words and kind != "for":
                f["has_assignment_in_condition"] = "true"
            if mixed(bones):
                f["mixed_logic"] = "true"
            if repeated(bones):
                f["dup_logic"] = "true"
            if kind == "for":
                f["for_style"] = "traditional" if words.count(";") == 2 else "range"
            if kind == "switch" and stop > b:
                inner = code[body:stop]
                has = any(x.text == "default" for x in inner)
                f["has_catch_all"] = "true" if has else "false"
                if has:
                    f["catch_all_kind"] = "default"
            if kind in ("if", "while"):
                for k in range(a, b):
                    if texts[k + 1] == "(" and code[k].kind == "name" and texts[k] not in _CONTROL:
                        calls[texts[k]] = calls.get(texts[k], 0) + 1
            places.append(at)
            if len(bones.strip("()")) > 4:
                seen[bones] = seen.get(bones, 0) + 1
        for at in places:
            if seen.get(self.rows[at].name, 0) > 1:
                self.rows[at].fields["duplicate_condition"] = "true"
        f = self.rows[row].fields
        f |= {"max_condition_tests": str(tests), "max_paren_depth": str(parens), "branch_count": str(branches)}
        twice = sorted(c for c, n in calls.items() if n > 1)
        if twice:
            f |= {"has_repeated_condition_calls": "true", "repeated_condition_calls": ",".join(twice)}
        nulls = {"NULL", "nullptr", "None"}
        f["null_check_count"] = str(sum([texts[i - 1] in nulls or texts[i + 1] in nulls for i, x in enumerate(texts[brace:end], brace) if x in ("==", "!=")]))

    def fallthrough(self, row: int, brace: int, end: int) -> None:
        """Cases that hold statements and run into the next one; the last case never counts."""
        code, count = self.code, 0
        for i in range(brace, end):
            if code[i].text != "switch" or code[i + 1].text != "(" or i + 1 not in self.close:
                continue
            a = self.close[i + 1] + 1
            if a not in self.close:
                continue
            b, depth, labels = self.close[a], 0, []
            for k in range(a + 1, b):
                depth += (code[k].text == "{") - (code[k].text == "}")
                if depth == 0 and code[k].text in ("case", "default"):
                    labels.append(k)
            for x, y in zip(labels, labels[1:]):
                colon = next((k for k in range(x, y) if code[k].text == ":"), y)
                body = [t for t in code[colon + 1 : y] if t.text not in ("{", "}", ";")]
                if not body:
                    continue
                tail = self.text[code[colon].end : code[y].at]
                last = [s for s in re.split(r"[;{}]", " ".join(t.text for t in code[colon + 1 : y])) if s.strip()][-1].split()
                if last[0] not in ("break", "return") and not _PASS.search(tail):
                    count += 1
        if count:
            self.rows[row].fields |= {"has_fallthrough": "true", "fallthrough_count": str(count)}

    def data_flow(self, row: int, params: list[str], brace: int, end: int, names: Counter) -> None:
        """Fields of a function's parameters, calls of itself and local variables; ``names`` counts those in its body."""
        code, texts, f = self.code, self.texts, self.rows[row].fields
        body = code[brace + 1 : end]
        unused = sorted({p for p in params if not names[p]})
        if unused:
            f |= {"has_unused_param": "true", "unused_param_count": str(len(unused)), "unused_params": ",".join(unused)}
        name = self.rows[row].name
        if name not in _CONTROL and (calls := sum([texts[i + 1] == "(" and code[i].kind == "name" for i, x in enumerate(texts[brace + 1 : end - 1], brace + 1) if x == name]) if names[name] else 0):
            f |= {"is_recursive": "true", "recursion_count": str(calls)}
        scopes: list[dict[str, int]] = [dict.fromkeys(params, -1)]
        shadows, declared, addresses = set(), {}, []
        rust = self.language == "rust"
        for i, (x, after) in enumerate(zip(texts[brace : end + 1], [*texts[brace + 1 : end + 2], ""]), brace):
            if x == "{":
                scopes.append({})
            elif x == "}" and len(scopes) > 1:
                scopes.pop()
            elif (rust or after in _DECLARED) and code[i].kind == "name" and self.declares(i):
                t = code[i]
                if any(t.text in s for s in scopes[:-1]):
                    shadows.add(t.text)
                scopes[-1][t.text] = i
                declared.setdefault(t.text, i)
                first = self.statement_start(i)
                self.add(t.text, "variable", first, i, row, **self.declared("local", [x.text for x in code[first:i]], "variable"))
        if shadows:
            f |= {"has_shadow": "true", "shadow_count": str(len(shadows)), "shadow_vars": ",".join(sorted(shadows))}
        far, total, conditional, level, deep = 0, 0, False, 0, []
        for t in body if declared else ():
            level += (t.text == "{") - (t.text == "}")
            deep.append(level)
        for v, i in declared.items():
            use = next((k for k in range(i + 1, end) if code[k].kind == "name" and code[k].text == v), None)
            if use is not None and code[use].line - code[i].line >= 2:
                total += code[use].line - code[i].line
                far += 1
                conditional |= i > brace and (deep[i - brace - 1] > 0 or deep[use - brace - 1] > 0)
        f["decl_distance"], f["decl_far_count"], f["decl_far_conditional"] = str(total), str(far), "true" if conditional else "false"
        arrays = {v for v, i in declared.items() if i + 1 < end and code[i + 1].text == "["}
        static = {v for v, i in declared.items() if "static" in [t.text for t in code[self.statement_start(i) : i]]}
        for i in range(brace, end) if declared else ():
            if texts[i] == "return":
                j = i + 1
                if code[j].text == "&" and code[j + 1].text in declared and code[j + 1].text not in static:
                    addresses.append((code[j + 1].text, "address_of", 1))
                elif code[j].text in arrays - static and code[j + 1].text == ";":
                    addresses.append((code[j].text, "array_decay", 2))
        if addresses:
            f |= {"has_escape": "true", "escape_tier": str(min(x[2] for x in addresses)), "escape_vars": ",".join(dict.fromkeys(x[0] for x in addresses)),
                  "escape_count": str(len({x[0] for x in addresses})), "escape_kinds": ",".join(sorted({x[1] for x in addresses}))}
        self.stores(row, declared, brace, end)

    def statement_start(self, i: int) -> int:
        while i > 0 and self.code[i - 1].text not in (";", "{", "}", "(", ")"):
            i -= 1
        return i

    def declares(self, i: int) -> bool:
        code, t = self.code, self.code[i]
        if self.language == "rust":
            return code[i - 1].text == "let" or (code[i - 1].text == "mut" and code[i - 2].text == "let") or (code[i - 1].text == "for")
        before, after = code[i - 1], code[i + 1].text if i + 1 < len(code) else ""
        if after not in _DECLARED or t.text in _CONTROL or before.text in ("return", "goto", "case", "else", "struct", "enum", "."):
            return False
        if before.text in ("*", "&") and code[i - 2].kind == "name" and code[i - 3].text in (";", "{", "}", "(", "const", "static"):
            return code[i - 2].text not in ("return", "case")
        return before.kind == "name" and before.text not in _CONTROL | {"break", "continue", "delete", "new", "throw"}

    def stores(self, row: int, declared: dict[str, int], brace: int, end: int) -> None:
        """A write that follows an unread write of a local variable."""
        code, pending, depth, f = self.code, {}, 0, self.rows[row].fields
        f |= {"has_unused_reassign": "false", "dead_store_conditional": "false"}
        for i in range(brace + 1, end) if declared else ():
            t = code[i]
            depth += (t.text == "{") - (t.text == "}")
            if t.kind != "name" or t.text not in declared:
                continue
            nxt = code[i + 1].text
            if nxt == "=" and code[i - 1].text in (";", "{", "}"):
                if pending.get(t.text) == depth:
                    f["has_unused_reassign" if depth == 0 else "dead_store_conditional"] = "true"
                pending[t.text] = depth
            elif i == declared[t.text] and nxt == "=":
                pending[t.text] = depth
            else:
                pending.pop(t.text, None)

    def content(self, row: int, brace: int, end: int) -> None:
        """Rows of numbers, casts and operators in a function, and its counts of them."""
        code, texts, casts = self.code, self.texts, 0
        for i in [i for i, x in enumerate(texts[brace + 1 : end], brace + 1) if x not in _PLAIN_OPS]:
            t, after = code[i], texts[i + 1]
            if t.kind == "name" and after in ("(", "[", "{") and i + 1 in self.close and t.text not in _CONTROL and (after == "(" or t.text.endswith("!")):
                called = self.arguments(i + 1)
                kind = "macro_call" if t.text.endswith("!") else "call"
                self.add(t.text.rstrip("!"), kind, i, self.close[i + 1], row, arguments="\x1f".join(called), argument_count=str(len(called)))
            if t.kind == "number":
                self.number(i, row)
            elif t.text in ("++", "--"):
                pre = code[i + 1].kind == "name" and code[i - 1].kind != "name"
                operand = code[i + 1].text if pre else code[i - 1].text
                self.add(f"{t.text}{operand}" if pre else f"{operand}{t.text}", "increment", i, i, row, increment_style="prefix" if pre else "postfix", increment_op=t.text, operand=operand, operator_category="increment")
            elif t.text in _COMPOUND:
                self.add(f"{code[i - 1].text} {t.text}", "compound_assign", i, i, row, compound_op=t.text, operand=code[i - 1].text, operator_category="bitwise" if t.text[0] in "&|^<>" else "arithmetic")
            elif t.text in ("<<", ">>") and (code[i - 1].kind in ("name", "number") or code[i - 1].text == ")"):
                self.add(f"{code[i - 1].text} {t.text} {after}", "shift", i, i, row, shift_direction="left" if t.text == "<<" else "right", shift_operand=code[i - 1].text, shift_amount=after, operator_category="shift")
            elif t.text == "(" and i in self.close and code[i - 1].kind != "name" and self.close[i] - i in (2, 3) and code[i + 1].kind == "name":
                nxt = code[self.close[i] + 1]
                if (nxt.kind in ("name", "number") or nxt.text == "(") and self.language != "rust" and nxt.text not in _CONTROL:
                    kind = "".join(x.text for x in code[i + 1 : self.close[i]])
                    self.add(f"c_style<{kind}>", "cast", i, self.close[i], row, cast_style="c_style", cast_target_type=kind, cast_safety="unsafe")
                    casts += 1
            elif t.text == "as" and self.language == "rust":
                self.add(f"as<{after}>", "cast", i, i + 1, row, cast_style="as", cast_target_type=after, cast_safety="moderate")
                casts += 1
        if self.language == "cpp":
            for m in _CAST.finditer(self.text, code[brace].at, code[end].at):
                self.rows.append(Row(f"{m[1]}_cast<{m[2].strip()}>", "cast", m.start(), m.end(), self.line(m.start()), self.line(m.end()), row, {"cast_style": f"{m[1]}_cast", "cast_target_type": m[2].strip(), "cast_safety": _SAFETY[m[1]]}))
                casts += 1
        f = self.rows[row].fields
        f |= {"has_cast": "true" if casts else "false", "cast_count": str(casts)}
        inner = self.notes[bisect_right(self.noted, code[brace].at) : bisect_left(self.noted, code[end].at)]
        tags = [m[1].upper() for t in inner for m in _TODO.finditer(t.text)]
        if tags:
            f |= {"has_todo": "true", "todo_count": str(len(tags)), "todo_tags": ",".join(sorted(set(tags)))}

    def arguments(self, opened: int) -> list[str]:
        """The texts between the top-level commas of a call."""
        out, depth, at, stop = [], 0, self.code[opened].end, self.code[self.close[opened]].at
        for i, x in enumerate(self.texts[opened + 1 : self.close[opened]], opened + 1):
            if x in _BRACKETS:
                depth += 1 if x in _PAIRS else -1
            elif x == "," and depth == 0:
                t = self.code[i]
                out.append(self.text[at : t.at].strip())
                at = t.end
        last = self.text[at:stop].strip()
        return [*out, last] if out or last else []

    def number(self, i: int, parent: int) -> None:
        code, texts, t = self.code, self.texts, self.code[i]
        negative = i > 0 and texts[i - 1] == "-" and (i < 2 or (code[i - 2].kind not in ("name", "number") and texts[i - 2] != ")"))
        constant = self.names_constant(i - negative) or self.first_place(i)
        fields = {"num_sign": "negative" if negative else "positive", "is_magic": "false" if constant else "true", "has_separator": "true" if "_" in t.text or "'" in t.text else "false"}
        self.rows.append(Row(t.text, "number", t.at, t.end, t.line, t.line, parent, fields))

    def names_constant(self, i: int) -> bool:
        """Whether the literal at ``i`` is all that a declaration or an enumerator of C or C++ is set to."""
        code = self.code
        if self.language == "rust" or i < 2 or code[i - 1].text != "=":
            return False
        if next((x.text for x in code[i + 1 : i + 3] if x.kind != "number"), ";") not in (";", ",", "}"):
            return False
        start = self.statement_start(i)
        head = code[start : i - 1]
        words = [x.text for x in head]
        enumerator = len(head) == 1 or (len(head) > 1 and words[-2] == "," and start > 0 and code[start - 1].text == "{")
        if enumerator:
            owner = [x.text for x in code[self.statement_start(start - 1) : start]] if start else []
            return "enum" in owner
        return len([x for x in head if x.kind == "name"]) > 1 and words[0] not in ("return", "case", "goto") and not {".", "->"} & set(words)

    def first_place(self, i: int) -> bool:
        """Zero as a subscript."""
        code = self.code
        if i < 2 or i + 1 >= len(code) or code[i - 1].text != "[" or code[i + 1].text != "]" or not re.fullmatch(r"0[xXbB]?0*", code[i].text):
            return False
        return (code[i - 2].kind == "name" and code[i - 2].text not in _CONTROL) or code[i - 2].text in (")", "]")

    def preprocessor(self) -> None:
        for t in self.pres:
            end = self.line(t.end - 1)
            if m := re.match(r"\s*#\s*define\s+(\w+)(\(([^)]*)\))?\s*(.*)", t.text, re.S):
                f = {"value": " ".join(m[4].replace("\\\n", " ").split())}
                if m[2]:
                    f["macro_arity"] = str(len([x for x in m[3].split(",") if x.strip()]))
                    f["parameters"] = m[3].strip()
                self.rows.append(Row(m[1], "macro", t.at, t.end, t.line, end, -1, f))
            elif m := re.match(r'\s*#\s*include\s*[<"]([^>"]+)', t.text):
                self.rows.append(Row(m[1], "import", t.at, t.end, t.line, end, -1, {}))

    def comments(self) -> None:
        for t in self.notes:
            style = "doc_block" if t.text.startswith(("/**", "/*!")) else "doc_line" if t.text.startswith(("///", "//!")) else "block" if t.text.startswith("/*") else "line"
            self.rows.append(Row(t.text.split("\n", 1)[0][:60], "comment", t.at, t.end, t.line, self.line(t.end - 1), -1, {"comment_style": style}))

    def guards(self) -> None:
        """The preprocessor conditions that each row stands under."""
        frames, group = self.frames, self.group
        marks: list[tuple[int, list[dict]]] = [(0, [*frames])]
        for t in self.pres:
            if (more := conditions(t.text, frames, group)) is None:
                continue
            group = more
            marks.append((t.end, list(frames)))
        self.group = group
        places = [m[0] for m in marks]
        for r in self.rows if any(m[1] for m in marks) else ():
            k = bisect_right(places, r.start) - 1
            if not marks[k][1]:
                continue
            live = marks[k][1]
            text = " && ".join(f"({c['cond']})" if "||" in c["cond"] else c["cond"] for c in live)
            r.fields |= {"guard": text, "guard_kind": "preprocessor", "guard_group_id": str(live[-1]["group"]), "guard_branch": str(live[-1]["branch"])}
            yes = re.findall(r"(?<!!)\bdefined\s*\(?\s*(\w+)", text)
            no = re.findall(r"!\s*defined\s*\(?\s*(\w+)", text)
            every = sorted(set(re.findall(r"[A-Za-z_]\w*", text)) - {"defined"})
            r.fields |= {k: ",".join(v) for k, v in (("guard_defines", yes), ("guard_negates", no), ("guard_mentions", every)) if v}
        if self.language == "rust":
            self.attributes(group)

    def attributes(self, group: int) -> None:
        """The ``cfg`` attributes that each row stands under: an attribute guards the item that follows it, with all inside."""
        for t in self.pres:
            m = re.match(r"\s*#\s*\[\s*cfg\s*\((.*)\)\s*\]", t.text, re.S)
            if not m:
                continue
            group += 1
            near = min((r.start for r in self.rows if r.start >= t.end and r.fql_kind != "comment"), default=None)
            item = max((r for r in self.rows if r.start == near and r.fql_kind != "comment"), key=lambda r: r.end, default=None)
            if item is None:
                continue
            guard = cfg_guard(m[1].strip())
            for r in self.rows:
                if item.start <= r.start and r.end <= item.end:
                    had = r.fields.get("guard")
                    r.fields["guard"] = f"{had} && {guard['guard']}" if had else guard["guard"]
                    for k in ("guard_defines", "guard_negates", "guard_mentions"):
                        if names := [x for x in (r.fields.get(k), ",".join(guard[k])) if x]:
                            r.fields[k] = ",".join(names)
                    r.fields |= {"guard_kind": "attribute", "guard_group_id": str(group), "guard_branch": "0"}


def cfg_guard(cond: str) -> dict:
    """What a ``cfg`` condition says for sure: ``not(x)`` negates, ``all(..)`` defines each name, ``any(..)`` only mentions
    them, a plain name or ``key = "value"`` is defined."""
    out = {"guard": cond, "guard_defines": [], "guard_negates": [], "guard_mentions": []}
    m = re.fullmatch(r"(not|all|any)\s*\((.*)\)", cond, re.S)
    word, inner = (m[1], m[2].strip()) if m else ("", cond)
    parts, depth, at = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(inner[at:i])
            at = i + 1
    names = [k[0] for p in [*parts, inner[at:]] if (k := re.fullmatch(r"(\w+)(?:\s*=.*)?", p.strip(), re.S) and re.match(r"\w+", p.strip()))]
    if word == "not":
        names = names if re.fullmatch(r"\w+", inner) else []
        return out | {"guard": f"!{inner}", "guard_negates": names, "guard_mentions": names}
    return out | {"guard_defines": [] if word == "any" else names, "guard_mentions": names}


def snippet(text: str) -> str:
    """The first line of a text, cut at 60 characters."""
    line = text.split("\n", 1)[0].strip()
    return line if len(line) <= 60 else line[:60] + "…"


def modifier(word: str) -> str:
    return "is_mutable" if word == "mut" else f"is_{word}"


def negated(cond: str) -> str:
    if re.fullmatch(r"!\s*[\w()]+", cond):
        return cond.lstrip("! ")
    return f"!{cond}" if re.fullmatch(r"[\w]+(\(\w+\))?", cond) else f"!({cond})"


def nesting(words: list[str]) -> int:
    now = most = 0
    for w in words:
        now += (w == "(") - (w == ")")
        most = max(most, now)
    return most


def skeleton(words: list[str]) -> str:
    """A condition with its operands renamed in order: equal operands share a letter; at most 120 characters."""
    labels: dict[str, str] = {}
    out: list[str] = []
    operand: list[str] = []

    def close() -> None:
        if operand:
            text = " ".join(operand)
            n = len(labels)
            out.append(labels.setdefault(text, chr(97 + n) if n < 26 else chr(39 + n) if n < 52 else "$"))
            operand.clear()

    depth = 0
    for w in words:
        if w == "(" and operand:
            depth += 1
        if depth:
            operand.append(w)
            depth -= w == ")"
        elif w in _APART:
            close()
            out.append(f" {w} " if w not in ("!", "(", ")") else w)
        else:
            operand.append(w)
    close()
    text = " ".join("".join(out).split())
    return text if len(text) <= 120 else text[:120] + "…"


def top_level(text: str) -> str:
    if "(" not in text and ")" not in text:
        return text
    while text.startswith("(") and text.endswith(")") and balanced(text[1:-1]):
        text = text[1:-1].strip()
    flat, depth = [], 0
    for c in text:
        depth += c == "("
        flat.append(c if depth == 0 else " ")
        depth -= c == ")"
    return "".join(flat)


def balanced(text: str) -> bool:
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


@lru_cache(maxsize=10_000)
def mixed(bones: str) -> bool:
    flat = top_level(bones)
    return "&&" in flat and "||" in flat


@lru_cache(maxsize=10_000)
def repeated(bones: str) -> bool:
    """Equal operands in one chain of && or ||."""
    flat = top_level(bones)
    while bones.startswith("(") and bones.endswith(")") and balanced(bones[1:-1]):
        bones = bones[1:-1].strip()
    for op in ("||", "&&"):
        cuts = [m.start() for m in re.finditer(re.escape(op), flat)]
        if cuts:
            parts = [bones[a:b].strip() for a, b in zip([0, *(c + 2 for c in cuts)], [*cuts, len(bones)])]
            return len(set(parts)) < len(parts) or any(repeated(p) for p in parts)
    return False


def content_hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()[:16]
