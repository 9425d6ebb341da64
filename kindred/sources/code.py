"""Units of source code: a lexer by pattern for each language, functions by their braces or ends, names by position.

A language is a row of tables and a rule that finds function bodies; more are added with register(). A file's units come
from its text alone, so they are made in Arrow batches on the executors, with one crossing into Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import text as T
from kindred.functions.family import NAME
from kindred.operators.units import numbered
from kindred.sources.files import EXTENSIONS
from kindred.sources.golang import go_units
from kindred.sources.kinds import INT, STRING, go_kinds, marks

# Words of each language, names that are never renamed, and what ends a statement.
JS_KEYWORDS = """async await break case catch class const continue debugger default delete do else export extends false
finally for function if import in instanceof let new null of return static super switch this throw true try typeof
undefined var void while with yield abstract as declare enum implements interface module namespace private protected
public readonly type keyof infer is never unknown any"""
JS_KNOWN = """console document window global process require module exports Promise Array Object String Number Boolean
Error Map Set JSON Math Date RegExp Symbol Buffer setTimeout setInterval clearTimeout clearInterval parseInt parseFloat
isNaN isFinite undefined null NaN Infinity globalThis React Component useState useEffect useCallback useMemo useRef
useContext useReducer Fragment PropTypes createElement"""
RUBY_KEYWORDS = """BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module
next nil not or redo rescue retry return self super then true undef unless until when while yield raise require
require_relative include extend prepend attr_reader attr_writer attr_accessor private protected public"""
RUBY_KNOWN = """puts print p pp raise require require_relative include extend prepend attr_reader attr_writer
attr_accessor nil true false self ARGV STDIN STDOUT STDERR Kernel Object Class Module Enumerable Comparable Array Hash
String Integer Float Symbol Proc Lambda File IO Dir Regexp Range Time Struct OpenStruct"""
OBJC_KEYWORDS = """auto break case char const continue default do double else enum extern float for goto if int long
register return short signed sizeof static struct switch typedef union unsigned void volatile while id nil Nil BOOL YES NO
SEL IMP Class self super in out inout bycopy byref oneway strong weak copy assign retain nonatomic atomic readonly
readwrite nonnull nullable instancetype typeof block"""
OBJC_KNOWN = """self super nil Nil YES NO NULL NSLog NSString NSMutableString NSArray NSMutableArray NSDictionary
NSMutableDictionary NSSet NSMutableSet NSNumber NSInteger NSUInteger CGFloat NSError NSException NSData NSDate NSURL
NSObject NSNotificationCenter NSUserDefaults UIView UIViewController UITableView UICollectionView UILabel UIButton UIImage
UIImageView dispatch_async dispatch_sync dispatch_get_main_queue dispatch_queue_t dispatch_once CGRectMake CGSizeMake
CGPointMake NSLocalizedString true false TRUE FALSE"""
CSHARP_KEYWORDS = """abstract as base bool break byte case catch char checked class const continue decimal default delegate
do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal
is lock long namespace new null object operator out override params private protected public readonly ref return sbyte
sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort
using virtual void volatile while async await dynamic get set var value yield where nameof when init record required
global"""
CSHARP_KNOWN = """Console string int bool var object null true false void double float decimal long byte char short Task
ValueTask List Dictionary HashSet Queue Stack IEnumerable IList IDictionary ICollection IDisposable ILogger IConfiguration
IServiceProvider IHostedService Exception ArgumentException InvalidOperationException NullReferenceException StringBuilder
DateTime DateTimeOffset TimeSpan Guid HttpClient HttpContext HttpRequest HttpResponse JsonSerializer JsonConvert String
Int32 Boolean Object Array Enumerable Queryable Math Convert Activator CancellationToken CancellationTokenSource Assert
Fact Theory Test TestMethod"""
RUBY_STATEMENT_WORDS = "end ; raise return if unless while until yield ="

_QUOTED = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\''
_C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_NUMBER = r"[0-9][0-9a-fA-FxX_.]*"
_C_OPERATORS = r"<<=|>>=|->|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|>>"


@dataclass(frozen=True)
class Token:
    kind: str  # word, keyword, string, symbol, number or mark
    text: str
    line: int


@dataclass(frozen=True)
class Body:
    name: str
    receiver: str
    first: int  # of the body's tokens
    after: int
    start_line: int
    end_line: int


@dataclass(frozen=True)
class Language:
    name: str
    pattern: re.Pattern
    keywords: frozenset
    known: frozenset
    bodies: Callable[[list[Token]], Iterator[Body]]
    delimiters: frozenset
    marks: frozenset  # tokens that count as statements
    tokens_each: int  # to a statement, where no such token is
    units: Callable[[str, Config], Iterator[tuple]] | None = None  # a reader of its own, in place of all the above
    kinds: Mapping[str, int] = field(default_factory=dict)  # numbers of marks; any other mark counts as a name


def _pattern(comment: str, string: str, word: str, marks: str, number: str = _NUMBER, symbol: str = r"(?!)") -> re.Pattern:
    return re.compile(f"(?P<skip>\\s+|{comment})|(?P<string>{string})|(?P<symbol>{symbol})|(?P<number>{number})|(?P<word>{word})|(?P<mark>{marks}|.)", re.S | re.M)


def lex(text: str, language: Language) -> list[Token]:
    out, line, last = [], 1, 0
    for m in language.pattern.finditer(text):
        if m.lastgroup == "skip":
            continue
        line += text.count("\n", last, m.start())
        last = m.start()
        kind = m.lastgroup
        if kind == "word" and m[0] in language.keywords:
            kind = "keyword"
        out.append(Token(kind, m[0], line))
    return out


def closing(tokens: list[Token], at: int, opened: str, closed: str) -> int:
    """Where the bracket at `at` closes, -1 if it doesn't."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i].text == opened) - (tokens[i].text == closed)
        if depth == 0:
            return i
    return -1


def _braced(opening: Callable[[list[Token], int], tuple[str, int, int] | None]) -> Callable[[list[Token]], Iterator[Body]]:
    """Bodies from the brace that opening() finds for a token (name, brace, least tokens); nested ones are part of theirs."""

    def bodies(tokens: list[Token]) -> Iterator[Body]:
        i = 0
        while i < len(tokens):
            if (hit := opening(tokens, i)) and (end := closing(tokens, hit[1], "{", "}")) > 0:
                if end + 1 - hit[1] > hit[2]:
                    yield Body(hit[0], "", hit[1], end + 1, tokens[i].line, tokens[end].line)
                i = end
            i += 1

    return bodies


def _called(tokens: list[Token], i: int) -> int:
    """The brace after the parentheses that follow token i, or -1."""
    if i + 1 < len(tokens) and tokens[i].kind == "word" and tokens[i + 1].text == "(":
        end = closing(tokens, i + 1, "(", ")")
        if 0 < end < len(tokens) - 1 and tokens[end + 1].text == "{":
            return end + 1
    return -1


def _first(tokens: list[Token], lo: int, hi: int, *texts: str) -> int:
    return next((j for j in range(lo, min(hi, len(tokens))) if tokens[j].text in texts), -1)


def _script_opening(tokens: list[Token], i: int):
    at = i + 1 if tokens[i].text == "async" and i + 1 < len(tokens) else i
    t, n = tokens[at], len(tokens)
    if t.kind == "keyword" and t.text == "function":
        j = at + 1 + (at + 1 < n and tokens[at + 1].text == "*")
        name = tokens[j].text if j < n and tokens[j].kind == "word" else "<anonymous>"
        brace = _first(tokens, j, n, "{")
        return (name, brace, 2) if brace > 0 else None
    if (brace := _called(tokens, at)) > 0:
        return t.text, brace, 2
    if t.kind == "keyword" and t.text in ("const", "let", "var") and at + 1 < n and tokens[at + 1].kind == "word":
        stop = _first(tokens, at + 2, at + 25, "=>", "function", ";", "}")
        if stop > 0 and tokens[stop].text in ("=>", "function"):
            brace = _first(tokens, stop + 1, stop + 5 if tokens[stop].text == "=>" else n, "{")
            if brace > 0:
                return tokens[at + 1].text, brace, 2
    return None


def _sharp_opening(tokens: list[Token], i: int):
    if (brace := _called(tokens, i)) > 0:
        return tokens[i].text, brace, 2
    if tokens[i].kind == "keyword" and tokens[i].text in ("get", "set") and i + 1 < len(tokens) and tokens[i + 1].text == "{":
        return tokens[i].text, i + 1, 4
    return None


def _objc_opening(tokens: list[Token], i: int):
    if tokens[i].text in ("-", "+"):
        stop = _first(tokens, i + 1, len(tokens), "{", ";")
        if stop > 0 and tokens[stop].text == "{":
            return next((t.text for t in tokens[i + 1 : stop] if t.kind == "word"), ""), stop, 2
    if (brace := _called(tokens, i)) > 0:
        return tokens[i].text, brace, 2
    return None


def _ruby_bodies(tokens: list[Token]) -> Iterator[Body]:
    """From def to its end. if, unless, while, until and for after an expression on their line open nothing."""
    i, n = 0, len(tokens)
    while i < n:
        if (tokens[i].kind, tokens[i].text) != ("keyword", "def"):
            i += 1
            continue
        line, i, name, receiver = tokens[i].line, i + 1, "", ""
        if i < n and tokens[i].kind in ("word", "keyword"):
            name, i = tokens[i].text, i + 1
            if i + 1 < n and tokens[i].text == ".":
                receiver, name, i = name, tokens[i + 1].text, i + 2
        first, depth = i, 1
        while i < n:
            t = tokens[i]
            if t.kind == "keyword":
                trailing = i > first and tokens[i - 1].line == t.line and tokens[i - 1].kind != "keyword" and tokens[i - 1].text != ";"
                if t.text in ("def", "do", "class", "module", "begin", "case") or t.text in ("if", "unless", "while", "until", "for") and not trailing:
                    depth += 1
                depth -= t.text == "end"
            if depth == 0:
                break
            i += 1
        if i > first:
            yield Body(name, receiver, first, i, line, tokens[i].line if i < n else line)
        i += 1


def _set(words: str) -> frozenset:
    return frozenset(words.split())


LANGUAGES: dict[str, Language] = {}


def register(language: Language, extensions: Iterable[str] = ()) -> None:
    """A later language of the same name takes the place of an earlier one; files of those extensions are its own."""
    LANGUAGES[language.name] = language
    EXTENSIONS.update({x.lower(): language.name for x in extensions})


register(
    Language(
        "javascript", _pattern(_C_COMMENTS, _QUOTED + r"|`(?:\\.|[^`\\])*`", r"[A-Za-z_$][\w$]*", r"===|!==|\.\.\.|>>>|\*\*=|=>|\?\?|\?\.|\*\*|" + _C_OPERATORS, r"[0-9][0-9a-fA-FxXn_.]*"),
        _set(JS_KEYWORDS), _set(JS_KNOWN), _braced(_script_opening), frozenset(";{}"), frozenset(";}"), 5, kinds=marks(),
    )
)
register(
    Language(
        "ruby", _pattern(r"#[^\n]*|^=begin.*?(?:^=end[^\n]*|\Z)", _QUOTED + r"|`[^`]*`|<<[~-]?(?P<here>[A-Z_]+)[^\n]*\n.*?^\s*(?P=here)$", r"@{0,2}[A-Za-z_]\w*[?!]?", r"\*\*|=>|==|!=|<=|>=|&&|\|\||<<|>>|\.\.|[-+*/%|&]=|::|=~", r"[0-9][0-9_.]*(?<!\.)", r":[A-Za-z_]\w*[?!]?"),
        _set(RUBY_KEYWORDS), _set(RUBY_KNOWN), _ruby_bodies, frozenset({"end", "\n"}), _set(RUBY_STATEMENT_WORDS), 4, kinds=marks("| &"),
    )
)
register(
    Language(
        "objc", _pattern(_C_COMMENTS + r"|#[^\n]*", '@?"(?:\\\\.|[^"\\\\])*"|\'(?:\\\\.|[^\'\\\\])*\'', r"@?[A-Za-z_]\w*", _C_OPERATORS),
        _set(OBJC_KEYWORDS) | {f"@{w}" for w in "interface implementation end property synthesize dynamic protocol class selector try catch finally throw autoreleasepool import optional required".split()},
        _set(OBJC_KNOWN), _braced(_objc_opening), frozenset(";}"), frozenset(";}"), 5, kinds=marks("& | ^"),
    )
)
register(
    Language(
        "csharp", _pattern(_C_COMMENTS + r"|^#[^\n]*", r'"""(?:.*?)"""|[$@]*@[$@]*"(?:""|[^"])*"|\$?"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', r"@?[A-Za-z_]\w*", r"\?\?=|\?\?|\?\.|=>|::|" + _C_OPERATORS, r"[0-9][0-9a-fA-FxXbB_.]*[uUlLmMdD]*"),
        _set(CSHARP_KEYWORDS), _set(CSHARP_KNOWN), _braced(_sharp_opening), frozenset(";}"), frozenset(";}"), 5, kinds=marks("& | ^") | {"~": marks("^")["^"]},
    )
)
register(Language("go", re.compile(""), frozenset(), frozenset(), lambda tokens: iter(()), frozenset(), frozenset(), 1, go_units))


def normalized(tokens: list[Token], language: Language, level: int) -> list[str]:
    """From level 1 on literals by kind, from level 2 on names by the order in which they come first."""
    names: dict[str, str] = {}
    kinds = {"string": "$STR", "symbol": "$SYM", "number": "$NUM"}
    out = []
    for t in tokens:
        if t.kind in kinds and level >= 1:
            out.append(kinds[t.kind])
        elif t.kind == "word" and level >= 2 and t.text not in language.known:
            out.append(names.setdefault(t.text, f"$V{len(names)}"))
        else:
            out.append(t.text)
    return out


def kinds_of(tokens: list[Token], language: Language) -> list[int]:
    """The number of each token's kind: strings and symbols are one kind, and words and keywords are names."""
    fixed = {"string": STRING, "symbol": STRING, "number": INT}
    return [fixed[t.kind] if t.kind in fixed else language.kinds.get(t.text, NAME) if t.kind == "mark" else NAME for t in tokens]


def statement_spans(norms: list[str], language: Language) -> list[tuple[int, int]]:
    """Where runs that end with a delimiter begin and end; a delimiter alone is none, and what is left at the end is one."""
    out, first = [], 0
    for i, t in enumerate(norms, 1):
        if t in language.delimiters:
            out += [(first, i)] * (i - first > 1)
            first = i
    return out + [(first, len(norms))] * (first < len(norms))


def statements_of(norms: list[str], language: Language) -> list[list[str]]:
    return [norms[a:b] for a, b in statement_spans(norms, language)]


def units_of(text: str, language: Language, cfg: Config) -> Iterator[tuple]:
    """(func_name, receiver, kind, start_line, end_line, stmt_count, tokens, kinds) of the functions and windows of a text.

    A window's lines are counted from its function's first by statements, not by lines.
    """
    if language.units:
        for u in language.units(text, cfg):
            yield *u, go_kinds(u[-1])
        return
    tokens, lines = lex(text, language), text.split("\n")
    for b in language.bodies(tokens):
        if any(cfg.ignore_directive in x for x in lines[max(0, b.start_line - 3) : b.start_line]):
            continue
        norms, kinds = normalized(tokens[b.first : b.after], language, cfg.level_number), kinds_of(tokens[b.first : b.after], language)
        n = sum(t in language.marks for t in norms) or len(norms) // language.tokens_each
        if n < cfg.min_statements or b.end_line - b.start_line + 1 < cfg.min_lines:
            continue
        yield b.name, b.receiver, "function", b.start_line, b.end_line, n, norms, kinds
        if n >= cfg.window_min_function:
            parts, w = statement_spans(norms, language), cfg.window_size
            for i in range(len(parts) - w + 1):
                at = [j for lo, hi in parts[i : i + w] for j in range(lo, hi)]
                if len(at) >= cfg.min_window_tokens:
                    yield b.name, b.receiver, "window", b.start_line + i, b.start_line + i + w, w, [norms[j] for j in at], [kinds[j] for j in at]


_SCHEMA = "number long, file string, ordinal int, func_name string, receiver string, kind string, start_line int, end_line int, stmt_count int, tokens array<string>, kinds array<int>"
_ARROW = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]


def _units_in(cfg: Config):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for number, file, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if language in LANGUAGES and text:
                    rows += [(number, file, i, *u) for i, u in enumerate(units_of(text, LANGUAGES[language], cfg))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ARROW, strict=True)], names)

    return run


def code_units(files: DataFrame, cfg: Config) -> DataFrame:
    """Units of files (root, file, language, text), in the schema of kindred.operators.units.

    Files are numbered by root and name; the window that does so sees names alone, no contents.
    """
    order = Window.orderBy("root", "file")
    numbers = files.select("root", "file").withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    rows = files.join(numbers, ["root", "file"]).select("number", "file", "language", "text").mapInArrow(_units_in(cfg), _SCHEMA)
    return rows.select(
        numbered(F.col("number"), F.col("ordinal")).alias("unit_idx"), "file", T.directory(F.col("file")).alias("dir"),
        "func_name", "receiver", "kind", "start_line", "end_line", "stmt_count", "tokens", "kinds", F.size("tokens").alias("n_tokens"), T.token_hash(F.col("tokens")).alias("token_hash"),
    )
