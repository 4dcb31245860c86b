"""Text of a statement to ``Statement``: a tokenizer and a table of statement forms."""

from __future__ import annotations

import re
from dataclasses import replace

from .statement import Clauses, Predicate, QueryError, Statement

_TOKEN = re.compile(
    r"""\s+|--[^\n]*
    |<<(?P<tag>[A-Z][A-Z0-9_]*)\n(?P<here>.*?)\n(?P=tag)(?=\n|$)
    |'(?P<single>[^']*)'|"(?P<double>[^"]*)"
    |(?P<op>>=|<=|!=|>|<|=)
    |(?P<bare>[A-Za-z0-9_:./*-]+)
    |(?P<punct>[(),])""",
    re.X | re.S,
)
ALIASES = {"kind": "fql_kind", "lang": "language", "file": "path", "content": "text", "ext": "extension"}


#: The first words of statements: a clause block ends before one.
OPENERS = ("FIND", "SHOW", "CHANGE", "INSERT", "DELETE", "COPY", "MOVE", "UNDO", "BEGIN", "COMMIT", "ROLLBACK", "USE", "CREATE", "REFRESH", "VACUUM", "VERIFY", "RUN", "JOB", "EXPORT")


class Token(str):
    quoted = False


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at : at + 12]!r}")
        at = m.end()
        for kind in ("here", "single", "double", "op", "bare", "punct"):
            if (value := m[kind]) is not None:
                token = Token(value)
                token.quoted = kind in ("here", "single", "double")
                out.append(token)
                break
    return out


class Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, *words: str) -> bool:
        part = self.tokens[self.at : self.at + len(words)]
        return len(part) == len(words) and all(t == w and not t.quoted for t, w in zip(part, words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise QueryError(f"expected {' '.join(words)} at {' '.join(self.tokens[self.at : self.at + 3]) or 'the end'!r}")

    def value(self) -> Token:
        if self.at >= len(self.tokens):
            raise QueryError("expected a value at the end")
        self.at += 1
        return self.tokens[self.at - 1]

    def number(self) -> int:
        word = self.value()
        if not re.fullmatch(r"[0-9]+", word):
            raise QueryError(f"expected a number, got {word!r}")
        return int(word)

    def span(self) -> tuple[int, int]:
        word = self.value()
        while not re.fullmatch(r"[0-9]+-[0-9]+", word) and self.at < len(self.tokens) and re.fullmatch(r"[0-9]+|-[0-9]*", self.tokens[self.at]):
            word += self.value()  # spaces around the dash
        if not (m := re.fullmatch(r"([0-9]+)-([0-9]+)", word)):
            raise QueryError(f"expected lines n-m, got {word!r}")
        return int(m[1]), int(m[2])

    def name(self) -> str:
        word = self.value()
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", word):
            raise QueryError(f"expected a field, got {word!r}")
        return ALIASES.get(word, str(word))

    def predicate(self) -> Predicate:
        field = self.name()
        for words in (("NOT", "MATCHES"), ("NOT", "LIKE"), ("MATCHES",), ("LIKE",)):
            if self.take(*words):
                return Predicate(field, " ".join(words), self.literal())
        op = self.value()
        if op not in (">=", "<=", "!=", ">", "<", "="):
            raise QueryError(f"expected a comparison, got {op!r}")
        return Predicate(field, str(op), self.literal())

    def literal(self) -> str | int | bool:
        """Signed number, then boolean, then any value; the choice is not taken back, so unquoted text that only
        starts like a number or a boolean is refused."""
        word = self.value()
        if word.quoted:
            return str(word)
        if re.match(r"-?[0-9]", word):
            if not re.fullmatch(r"-?[0-9]+", word):
                raise QueryError(f"quote {word!r}: it starts like a number")
            return int(word)
        if word.startswith(("true", "false")):
            if word not in ("true", "false"):
                raise QueryError(f"quote {word!r}: it starts like a boolean")
            return word == "true"
        return str(word)

    def clauses(self) -> Clauses:
        c = Clauses()
        while self.at < len(self.tokens):
            if self.take("WHERE") or self.take("AND"):
                c = replace(c, where=(*c.where, self.predicate()))
            elif self.take("HAVING"):
                c = replace(c, having=(*c.having, self.predicate()))
            elif self.take("IN"):
                c = replace(c, within=str(self.value()))
            elif self.take("EXCLUDE"):
                c = replace(c, exclude=(*c.exclude, str(self.value())))
            elif self.take("GROUP", "BY"):
                c = replace(c, group_by=self.name())
            elif self.take("ORDER", "BY"):
                field = self.name()
                up = self.take("ASC")
                self.take("DESC")
                c = replace(c, order_by=(field, up))
            elif self.take("LIMIT"):
                c = replace(c, limit=self.number())
            elif self.take("OFFSET"):
                c = replace(c, offset=self.number())
            elif self.take("DEPTH"):
                c = replace(c, depth=self.number())
            elif self.take("LINES"):
                c = replace(c, lines=self.number())
            elif self.take("USING"):
                self.value()  # one engine answers all
            elif self.peek(str(self.tokens[self.at])) and self.tokens[self.at] in OPENERS:
                break
            else:
                raise QueryError(f"unexpected {self.tokens[self.at]!r}")
        return c


def program(text: str) -> list[Statement]:
    """The statements of a text, one after another."""
    r = Reader(text)
    out = [_statement(r)]
    while r.at < len(r.tokens):
        out.append(_statement(r))
    return out


def parse(text: str) -> Statement:
    """One statement; raises QueryError with what was expected."""
    r = Reader(text)
    s = _statement(r)
    if r.at < len(r.tokens):
        raise QueryError(f"unexpected {r.tokens[r.at]!r}")
    return s


def _statement(r: Reader) -> Statement:
    if r.take("FIND"):
        for target in ("usages", "callees"):
            if r.take(target):
                r.need("OF")
                of = str(r.value())
                return Statement(f"find {target}", {"of": of}, r.clauses())
        for target in ("files", "symbols"):
            if r.take(target):
                return Statement(f"find {target}", {}, r.clauses())
        if r.take("globals"):
            c = r.clauses()
            extra = (Predicate("fql_kind", "=", "variable"), Predicate("scope", "=", "file"))
            return Statement("find symbols", {}, replace(c, where=(*extra, *c.where)))
        r.need("NODE")
        return Statement("find node", {"id": str(r.value())}, r.clauses())
    if r.take("SHOW"):
        return _show(r)
    if r.take("CHANGE"):
        return _change(r)
    if r.take("INSERT", "NODE", "FOR"):
        path = str(r.value())
        return Statement("insert path", {"path": path, "content": str(r.value()) if r.take("WITH") else ""}, r.clauses())
    if r.take("INSERT"):
        side = _side(r)
        node, rev = str(r.value()), _rev(r)
        r.need("WITH")
        return Statement("insert node", {"id": node, "side": side, "rev": rev, "content": str(r.value())}, r.clauses())
    if r.take("DELETE"):
        if r.take("NODES", "FOUND"):
            return Statement("delete found", {"rev": _rev(r)}, r.clauses())
        r.need("NODE")
        return Statement("delete node", {"id": str(r.value()), "rev": _rev(r)}, r.clauses())
    for verb in ("COPY", "MOVE"):
        if r.take(verb):
            return _relocate(r, verb.lower())
    if r.take("UNDO"):
        last = r.value() if r.at < len(r.tokens) and re.fullmatch(r"LAST-[0-9]+", r.tokens[r.at]) else "LAST-0"
        return Statement("undo", {"last": int(last.removeprefix("LAST-"))})
    if r.take("BEGIN", "TRANSACTION"):
        return Statement("begin", {"name": str(r.value())})
    if r.take("COMMIT"):
        r.need("MESSAGE")
        return Statement("commit", {"message": str(r.value())})
    if r.take("ROLLBACK"):
        return Statement("rollback", {"name": str(r.value()) if r.take("TRANSACTION") else None})
    if r.take("USE"):
        source, dot, branch = r.value().partition(".")
        r.need("AS")
        if not (source and dot and branch):
            raise QueryError("expected source.branch")
        return Statement("use", {"source": source, "branch": branch, "alias": str(r.value())})
    if r.take("CREATE", "SOURCE"):
        name = str(r.value())
        r.need("FROM")
        return Statement("create source", {"name": name, "url": str(r.value())})
    if r.take("REFRESH", "SOURCE"):
        return Statement("refresh source", {"name": str(r.value())})
    if r.take("VACUUM"):
        args = {"source": str(r.value()) if r.take("SOURCE") else None, "keep": r.number() if r.take("KEEP") else 0}
        return Statement("vacuum", {**args, "all": r.take("ALL"), "apply": r.take("APPLY")})
    for words in (("VERIFY", "build"), ("RUN",), ("JOB",), ("EXPORT", "PATCH")):
        if r.peek(*words):
            raise QueryError(f"{' '.join(words)} acts on a machine's shell or a git tree, not on a corpus")
    raise QueryError(f"unknown statement {' '.join(r.tokens[:2])!r}")


def _side(r: Reader) -> str:
    side = "before" if r.take("BEFORE") else "after"
    if side == "after":
        r.need("AFTER")
    r.need("NODE")
    return side


def _rev(r: Reader) -> str | None:
    return str(r.value()) if r.take("IF", "REV") else None


def _show(r: Reader) -> Statement:
    for target in ("body", "context", "signature", "members", "callees", "outline"):
        if r.take(target):
            r.need("OF")
            args = {"of": str(r.value())}
            if target == "outline":
                args["all"] = r.take("ALL")
            return Statement(f"show {target}", args, r.clauses())
    if r.take("LINES"):
        span = r.span()
        r.need("OF")
        return Statement("show lines", {"span": span, "of": str(r.value())}, r.clauses())
    if r.take("NODE"):
        node = str(r.value())
        mode = "metadata" if r.take("METADATA") else "content"
        r.take("CONTENT")
        return Statement("show node", {"id": node, "mode": mode}, r.clauses())
    if r.take("MORE"):
        args: dict = {"last": 0, "window": None}
        if r.at < len(r.tokens) and re.fullmatch(r"LAST-[0-9]+", r.tokens[r.at]):
            args["last"] = int(r.value()[5:])
        if r.take("HEAD"):
            args["window"] = ("head", r.number())
        elif r.take("TAIL"):
            args["window"] = ("tail", r.number())
        elif r.at < len(r.tokens) and re.fullmatch(r"[0-9]+-[0-9]+", r.tokens[r.at]):
            args["window"] = ("range", r.span())
        return Statement("show more", args, r.clauses())
    if r.take("DIFF"):
        stat = r.take("STAT")
        of = str(r.value()) if r.take("OF") else None
        return Statement("show diff", {"stat": stat, "of": of}, r.clauses())
    if r.take("STATS"):
        return Statement("show stats", {"of": str(r.value()) if r.take("FOR") else None}, r.clauses())
    for target in ("COMMITS", "SOURCES", "BRANCHES", "VERSION"):
        if r.take(target):
            return Statement(f"show {target.lower()}", {}, r.clauses())
    raise QueryError("unknown SHOW target")


def _change(r: Reader) -> Statement:
    if r.take("NODES", "FOUND"):
        rev = _rev(r)
        return Statement("change found", {**_edit(r), "rev": rev}, r.clauses())
    if r.take("NODE"):
        node = str(r.value())
        rev = _rev(r)
        return Statement("change node", {"id": node, **_edit(r), "rev": rev}, r.clauses())
    if not (r.take("FILES") or r.take("FILE")):
        raise QueryError("expected FILE, FILES, NODE or NODES FOUND")
    paths = [str(r.value())]
    while r.take(","):
        paths.append(str(r.value()))
    return Statement("change files", {"paths": paths, **_edit(r)}, r.clauses())


def _edit(r: Reader) -> dict:
    if r.take("MATCHING"):
        word = r.take("WORD")
        old = str(r.value())
        r.need("WITH")
        return {"mode": "matching", "word": word, "old": old, "new": str(r.value())}
    if r.take("LINES"):
        span = r.span()
        if r.take("NOTHING"):
            return {"mode": "lines", "span": span, "new": ""}
        r.need("WITH")
        return {"mode": "lines", "span": span, "new": "" if r.take("NOTHING") else str(r.value())}
    r.need("WITH")
    return {"mode": "delete"} if r.take("NOTHING") else {"mode": "whole", "new": str(r.value())}


def _relocate(r: Reader, verb: str) -> Statement:
    if r.take("LINES"):
        span = r.span()
        r.need("OF")
        args = {"span": span, "of": str(r.value())}
        r.need("TO")
        args["to"] = str(r.value())
        args["line"] = r.number() if r.take("AT", "LINE") else None
        return Statement(f"{verb} lines", args, r.clauses())
    if r.take("NODES", "FOUND"):
        rev = _rev(r)
        r.need("TO")
        return Statement(f"{verb} found", {"to": str(r.value()), "rev": rev}, r.clauses())
    r.need("NODE")
    node, rev = str(r.value()), _rev(r)
    if r.take("TO"):
        return Statement(f"{verb} node to", {"id": node, "to": str(r.value()), "rev": rev}, r.clauses())
    side = _side(r)
    return Statement(f"{verb} node", {"id": node, "side": side, "anchor": str(r.value()), "rev": rev}, r.clauses())
