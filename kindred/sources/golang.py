"""Units of Go source: a reader that goes through a function once and gives its normalized tokens as it reads them.

Operators need no precedence, since tokens are given in the order of the source; what matters is whether a name stands
for a value or a type, and where a statement ends. Level 0 keeps all, level 1 replaces literals by their kind, level 2
also names by their role and order: $R receiver, $P parameters, $RET results, $V values, $LABEL labels. Names of types
and of what follows a point stay. Windows of statements count their names afresh.

A function that can't be read to its end is left out, and reading goes on at the next one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from kindred.config import Config

# Words and signs of the language, and what stands for forms that have no tokens of their own.
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
CONSTANTS = {"nil", "true", "false", "iota"}
SIGNS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^".split()
ASSIGNING = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}
BINARY = {"||", "&&", "==", "!=", "<", "<=", ">", ">=", "+", "-", "|", "^", "*", "/", "%", "<<", ">>", "&", "&^"}
UNARY = {"+", "-", "!", "^", "*", "&", "<-"}
KINDS = {"string": "$STR", "rune": "$RUNE", "float": "$FLOAT", "int": "$INT"}
ROLES = {"value": "$V", "parameter": "$P", "result": "$RET", "label": "$LABEL"}

_PATTERN = re.compile(
    r"(?P<skip>[ \t\r]+|//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>\n)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)|(?P<rune>'(?:\\.[^'\n]*|[^'\\\n])')"
    r"|(?P<float>(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9_]+)?|[0-9][0-9_]*[eE][-+]?[0-9_]+)|(?P<int>0[xXbBoO][0-9a-fA-F_]+|[0-9][0-9_]*)"
    r"|(?P<word>[^\W\d]\w*)|(?P<sign>" + "|".join(map(re.escape, SIGNS)) + r"|.)",
    re.S,
)
_ENDS = {")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return"}


class Unreadable(Exception):
    pass


def lexed(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line), with the semicolons that line ends stand for."""
    out, line = [], 1
    for m in _PATTERN.finditer(text):
        kind, t = m.lastgroup, m[0]
        n = t.count("\n")
        if kind == "line" or kind == "block" and n:
            if out and (out[-1][0] in KINDS or out[-1][0] == "name" or out[-1][1] in _ENDS):
                out.append(("sign", ";", line))
        elif kind not in ("skip", "block"):
            out.append(("keyword" if t in KEYWORDS else "name" if kind == "word" else kind, t, line))
        line += n
    return [*out, ("sign", ";", line)]


class Reader:
    def __init__(self, tokens, at: int, level: int):
        self.tokens, self.at, self.level = tokens, at, level
        self.out: list[str] = []
        self.seen: dict[str, str] = {}
        self.counts = dict.fromkeys(ROLES, 0)

    # the source
    def text(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] not in KINDS else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def take(self, *texts: str) -> str:
        t = self.text()
        if not t or texts and t not in texts:
            raise Unreadable(t)
        self.at += 1
        return t

    def give(self, *texts: str) -> None:
        self.out += [self.take(*texts)]

    def skipped(self, opened: str, closed: str) -> None:
        """Goes past a bracket and all in it."""
        depth = 0
        while True:
            t = self.take() if self.text() else self._literal()
            depth += (t == opened) - (t == closed)
            if not depth:
                return

    def _literal(self) -> str:
        if self.kind() not in KINDS:
            raise Unreadable("end")
        self.at += 1
        return ""

    # names
    def name(self, role: str) -> None:
        if self.kind() != "name":
            raise Unreadable(self.text())
        t = self.take()
        if self.level >= 2:
            if t not in self.seen:
                self.seen[t] = "$R" if role == "receiver" else f"{ROLES[role]}{self.counts[role]}"
                if role != "receiver":
                    self.counts[role] += 1
            t = self.seen[t]
        self.out.append(t)

    def value_name(self) -> None:
        if self.text() == "_" or self.text() in CONSTANTS:
            self.give()
        else:
            self.name("value")

    # types
    def type(self) -> None:
        t = self.text()
        if self.kind() == "name":
            if self.text(1) == ".":
                self.value_name()
                self.give(".")
            self.give()
            if self.text() == "[" and self.text(1) != "]":  # of a generic type
                self.skipped("[", "]")
                self.out[-1:] = ["$TYPE_*ast.IndexExpr"]
        elif t in ("*", "..."):
            self.give()
            if t == "*" or self.text() not in (")", "]"):
                self.type()
        elif t == "[":
            self.give()
            if self.text() != "]":
                self.give() if self.text() == "..." else self.expression()
            self.give("]")
            self.type()
        elif t == "map":
            self.give()
            self.give("[")
            self.type()
            self.give("]")
            self.type()
        elif t == "chan" or t == "<-" and self.text(1) == "chan":
            self.at += t == "<-"
            self.give("chan")
            self.at += self.text() == "<-"
            self.type()
        elif t == "func":
            self.give()
            self.signature()
        elif t in ("interface", "struct"):
            self.take()
            self.skipped("{", "}")
            self.out.append(t + "{}")
        elif t == "(":
            self.skipped("(", ")")
            self.out.append("$TYPE_*ast.ParenExpr")
        else:
            raise Unreadable(t)

    def signature(self) -> None:
        self.fields("parameter")
        if self.text() == "(":
            self.fields("result")
        elif self.kind() == "name" or self.text() in ("*", "[", "map", "chan", "func", "interface", "struct", "<-"):
            self.out.append("(")
            self.type()
            self.out.append(")")

    def _parts(self) -> list[int]:
        """Numbers of tokens of the parts between the commas of the list that begins here."""
        depth, i, parts, size = 0, self.at, [], 0
        while True:
            if i >= len(self.tokens):
                raise Unreadable("end")
            t = self.tokens[i][1] if self.tokens[i][0] not in KINDS else ""
            depth += (t in "([{" if t else 0) - (t in ")]}" if t else 0)
            if depth < 0 or t == "," and depth == 0:
                parts.append(size)
                size = -1
                if depth < 0:
                    return parts if parts[-1] else parts[:-1]
            size += 1
            i += 1

    def fields(self, role: str) -> None:
        self.give("(")
        self.at += self.text() == ";"
        parts, at = self._parts(), self.at

        def named(lo: int, n: int) -> bool:
            if n < 2 or self.tokens[lo][0] != "name" or self.tokens[lo + 1][1] == ".":
                return False
            return not (self.tokens[lo + 1][1] == "[" and self.tokens[lo + n - 1][1] == "]")

        starts = [at + sum(parts[:i]) + i for i in range(len(parts))]
        any_named = any(named(lo, n) for lo, n in zip(starts, parts, strict=True))
        for i in range(len(parts)):
            if i:
                self.give(",")
            if any_named:
                self.name(role)
            if self.text() not in (",", ")"):
                self.type()
        self.at += self.text() == ","
        self.at += self.text() == ";"
        self.give(")")

    # values
    def expressions(self, header: bool = False) -> None:
        self.expression(header)
        while self.text() == ",":
            self.give()
            self.expression(header)

    def expression(self, header: bool = False) -> None:
        """header: a brace begins a block, not a value of the type before it."""
        while self.text() in UNARY and not (self.text() == "<-" and self.text(1) == "chan"):
            self.give()
        self.operand(header)
        if self.text() in BINARY:
            self.give()
            self.expression(header)

    def _is_type_of_value(self, header: bool) -> bool:
        if header or self.kind() != "name":
            return False
        return self.text(1) == "{" or self.text(1) == "." and self.kind(2) == "name" and self.text(3) == "{"

    def operand(self, header: bool) -> None:
        t, kind = self.text(), self.kind()
        if kind in KINDS:
            self.out.append(KINDS[kind] if self.level >= 1 else self.tokens[self.at][1])
            self.at += 1
        elif self._is_type_of_value(header):
            self.type()
            self.elements()
        elif kind == "name":
            self.value_name()
        elif t == "(":
            self.give()
            self.expression()
            self.give(")")
        elif t == "func":
            self.give()
            self.signature()
            if self.text() == "{":
                self.block()
        elif t in ("[", "map", "chan", "struct", "interface", "<-", "..."):
            self.type()
            if self.text() == "{":
                self.elements()
        else:
            raise Unreadable(t)
        self.follow(header)

    def follow(self, header: bool) -> None:
        while True:
            t = self.text()
            if t == ".":
                self.give()
                if self.text() == "(":
                    self.give()
                    self.give("type") if self.text() == "type" else self.type()
                    self.give(")")
                else:
                    self.give()
            elif t == "(":
                self.give()
                self.list(")")
                self.give(")")
            elif t == "[":
                self.give()
                while self.text() != "]":
                    self.give() if self.text() in (":", ",") else self.expression()
                self.give("]")
                if self.text() == "{" and not header:
                    self.elements()
            else:
                return

    def list(self, closed: str) -> None:
        first = True
        while self.text() != closed:
            if not first:
                self.take(",")
                if self.text() == ";":
                    self.at += 1
                if self.text() == closed:
                    return
                self.out.append(",")
            first = False
            self.element()
            if self.text() == "...":
                self.give()
            self.at += self.text() == ";"

    def element(self) -> None:
        self.elements() if self.text() == "{" else self.expression()
        if self.text() == ":":
            self.give()
            self.elements() if self.text() == "{" else self.expression()

    def elements(self) -> None:
        self.give("{")
        self.list("}")
        self.give("}")

    # statements
    def block(self) -> list[tuple[int, int]]:
        """Reads a block; where its statements begin and end."""
        self.give("{")
        out = self.statements("}")
        self.give("}")
        return out

    def statements(self, *closed: str) -> list[tuple[int, int]]:
        out = []
        while self.text() not in closed:
            if self.text() == ";":
                self.at += 1
                continue
            first = self.at
            self.statement()
            out.append((first, self.at))
            if self.text() not in closed:
                self.take(";")
        return out

    def statement(self) -> None:
        t = self.text()
        if t == "{":
            self.block()
        elif t == "return":
            self.give()
            if self.text() not in (";", "}"):
                self.expressions()
        elif t in ("break", "continue", "goto", "fallthrough"):
            self.give()
            self.at += self.kind() == "name"
        elif t in ("defer", "go"):
            self.give()
            self.expression()
        elif t in ("var", "const", "type"):
            self.declaration()
        elif t == "if":
            self.give()
            self.header()
            self.block()
            if self.text() == "else":
                self.give()
                self.statement()
        elif t == "for":
            self.loop()
        elif t in ("switch", "select"):
            self.give()
            if self.text() != "{":
                self.header()
            self.clauses()
        elif self.kind() == "name" and self.text(1) == ":":
            self.name("label")
            self.give(":")
            self.at += self.text() == ";"
            if self.text() != "}":
                self.statement()
        else:
            self.simple()

    def simple(self, header: bool = False) -> None:
        self.expressions(header)
        t = self.text()
        if t in ASSIGNING:
            self.give()
            if self.text() == "range":
                self.give()
            self.expressions(header)
        elif t in ("++", "--"):
            self.give()
        elif t == "<-":
            self.give()
            self.expression(header)

    def header(self) -> None:
        """[first;] [condition] before a block."""
        if self.text() != ";":
            self.simple(True)
        if self.text() == ";":
            self.give()
            if self.text() != "{":
                self.simple(True)

    def loop(self) -> None:
        self.give("for")
        if self.text() == "range":
            self.out.append("ILLEGAL")  # no sign of assignment
            self.give()
            self.expression(True)
        elif self.text() != "{":
            before = len(self.out)
            if self.text() != ";":
                self.simple(True)
            if self.text() == ";":
                if len(self.out) > before:
                    self.out.append(";")
                self.at += 1
                if self.text() != ";":
                    self.expression(True)
                    self.out.append(";")
                self.at += self.text() == ";"
                if self.text() != "{":
                    self.simple(True)
            elif "range" not in self.out[before:]:
                self.out.append(";")
        self.block()

    def clauses(self) -> None:
        self.give("{")
        while self.text() != "}":
            self.out.append("case")
            if self.take("case", "default") == "case":
                self.simple()
            self.give(":")
            self.statements("case", "default", "}")
        self.give("}")

    def declaration(self) -> None:
        what = self.take()
        self.out.append(what)
        if self.text() != "(":
            return self.spec(what)
        self.take()
        while self.text() != ")":
            if self.text() == ";":
                self.at += 1
            else:
                self.spec(what)
        self.take(")")

    def spec(self, what: str) -> None:
        self.name("value")
        if what == "type":
            if self.text() == "[" and self.kind(1) == "name" and self.text(2) != "]":
                self.skipped("[", "]")
            self.at += self.text() == "="
            return self.type()
        while self.text() == ",":
            self.give()
            self.name("value")
        if self.text() not in ("=", ";", ")"):
            self.type()
        if self.text() == "=":
            self.take()
            while True:
                self.out.append("=")
                self.expression()
                if self.text() != ",":
                    return
                self.take()


def _receiver(tokens, lo: int, hi: int) -> str:
    """The receiver's type: a name, or names with points, after stars."""
    part = [t for _, t, _ in tokens[lo:hi]]
    if len(part) > 1 and part[0] not in ("*", "(") and part[1] != ".":
        part = part[1:]
    return "".join(part) if all(t in ("*", ".") or t.isidentifier() for t in part) else ""


def _ignored(lines: list[str], first: int, directive: str) -> bool:
    """Whether the comment right above line `first` has the directive."""
    at = first - 2
    while at >= 0 and (x := lines[at].strip()) and (x.startswith(("//", "/*", "*")) or x.endswith("*/")):
        if directive in x:
            return True
        at -= 1
    return False


def go_units(text: str, cfg: Config) -> Iterator[tuple]:
    """(func_name, receiver, kind, start_line, end_line, stmt_count, tokens) of the functions and windows of a text."""
    tokens, lines, at, depth = lexed(text), text.split("\n"), 0, 0
    while at < len(tokens):
        kind, t, line = tokens[at]
        if kind not in KINDS:
            depth += (t in ("{", "(")) - (t in ("}", ")"))
        if (kind, t) != ("keyword", "func") or depth:
            at += 1
            continue
        try:
            yield from _function(tokens, at, line, lines, cfg)
        except Unreadable:
            pass
        at += 1


def _function(tokens, at: int, line: int, lines: list[str], cfg: Config) -> Iterator[tuple]:
    r, receiver = Reader(tokens, at + 1, cfg.level_number), ""
    if r.text() == "(":
        r.give()
        lo = r.at
        if r.kind() == "name" and r.text(1) not in (")", "."):
            r.name("receiver")
        r.type()
        receiver = _receiver(tokens, lo, r.at)
        r.give(")")
    name = r.take()
    r.out += ["func", "$FUNC" if cfg.level_number >= 2 else name]
    if r.text() == "[":
        r.skipped("[", "]")
    r.signature()
    if r.text() != "{":
        return
    parts = r.block()
    end = tokens[r.at - 1][2]
    if len(parts) < cfg.min_statements or end - line + 1 < cfg.min_lines or _ignored(lines, line, cfg.ignore_directive):
        return
    yield name, receiver, "function", line, end, len(parts), r.out
    w = cfg.window_size
    for i in range(len(parts) - w + 1 if len(parts) >= cfg.window_min_function else 0):
        part = Reader(tokens, parts[i][0], cfg.level_number)
        for first, _ in parts[i : i + w]:
            part.at = first
            part.statement()
        if part.out:
            yield name, receiver, "window", tokens[parts[i][0]][2], tokens[parts[i + w - 1][1] - 1][2], w, part.out
