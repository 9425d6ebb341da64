"""Numbers of token kinds, which the hash family of kindred.functions.family takes in beside each token's text."""

from __future__ import annotations

from kindred.functions.family import NAME

# Kinds are numbered as the tokens of Go, operators and keywords in the order of its specification.
INT, FLOAT, IMAGINARY, RUNE, STRING = 5, 6, 7, 8, 9
GO_OPERATORS = "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! != <= >= := ... ( [ { , . ) ] } ; :".split()
GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
FIRST_OPERATOR, FIRST_KEYWORD = 12, 61
#: Marks that have a kind of their own in the other languages; any other mark counts as a name.
MARKS = "( ) { } [ ] ; , . : = + - * / < > !".split()
#: Texts that Go units hold as names although they are keywords.
GO_NAMES = {"map", "chan"}
GO_LITERALS = {"$INT": INT, "$FLOAT": FLOAT, "$RUNE": RUNE, "$STR": STRING}

_GO = {t: FIRST_OPERATOR + i for i, t in enumerate(GO_OPERATORS)} | {t: FIRST_KEYWORD + i for i, t in enumerate(GO_KEYWORDS) if t not in GO_NAMES} | GO_LITERALS


def marks(more: str = "") -> dict[str, int]:
    """Kinds of a language's marks: the common ones and more."""
    return {t: _GO[t] for t in [*MARKS, *more.split()]}


def go_kinds(tokens: list[str]) -> list[int]:
    """Kinds of normalized Go tokens. The type of a type switch, after a parenthesis, is a name."""
    out = []
    for i, t in enumerate(tokens):
        if t in _GO:
            out.append(NAME if t == "type" and i and tokens[i - 1] == "(" else _GO[t])
        elif t[:1] in ('"', "`"):
            out.append(STRING)
        elif t[:1] == "'":
            out.append(RUNE)
        elif t[:1].isdigit() or t[:1] == "." and t[1:2].isdigit():
            whole = t[:2].lower() in ("0x", "0b", "0o") or not set(t.lower()) & {".", "e"}
            out.append(IMAGINARY if t.endswith("i") else INT if whole else FLOAT)
        else:
            out.append(NAME)
    return out
