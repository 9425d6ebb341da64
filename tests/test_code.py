from kindred.config import Config
from kindred.plans.engine import analyze
from kindred.sources.code import LANGUAGES, code_units, kinds_of, lex, normalized, statements_of, units_of
from kindred.sources.files import read_files
from kindred.sources.kinds import go_kinds

SCRIPT = """
// a user
export class {N}Service {{
  async load{N}(id) {{
    const {n} = await this.repo.find(id);
    if (!{n}) {{
      throw new Error("no {n}");
    }}
    this.log.info(`loaded ${{id}}`);
    this.cache.set(id, {n});
    this.count += 1;
    return {n};
  }}
}}
"""
RUBY = """class {N}
  def find_{n}(id)
    {n} = repo.find(id)
    raise ArgumentError, "no {n}" unless {n}
    log(:found, id) if verbose
    items.each do |x|
      x.call({n})
    end
    return {n}
  end
end
"""
SHARP = r'''public class {N}Controller {{
    public int Get{N}(int id) {{
        var {n} = _repo.Find(id);
        if ({n} == null) {{
            throw new Exception($"no {{id}}");
        }}
        _log.Info(@"a ""b""");
        return {n}.Size;
    }}
}}
'''
OBJC = """#import "X.h"
@implementation {N}
- ({N} *)fetch{N}:(int)number {{
    NSString *{n} = [self.store get:number];
    if ({n} == nil) {{
        NSLog(@"no {n}");
        return nil;
    }}
    [self.cache put:{n}];
    return {n};
}}
@end
"""


def test_lexers():
    kinds = lambda text, lang: [(t.kind, t.text) for t in lex(text, LANGUAGES[lang])]
    assert kinds("a ??= /* x */ 'b\\'' // c", "javascript")[:1] == [("word", "a")]
    assert kinds("x = :sym # c", "ruby") == [("word", "x"), ("mark", "="), ("symbol", ":sym")]
    assert kinds('#if X\nreturn @"a""b";', "csharp") == [("keyword", "return"), ("string", '@"a""b"'), ("mark", ";")]
    assert kinds('#define A\nNSLog(@"x");', "objc")[0] == ("word", "NSLog")
    assert [t.line for t in lex("a\n\nb `x\ny` c", LANGUAGES["javascript"])] == [1, 3, 3, 4]


def test_levels_and_statements():
    js = LANGUAGES["javascript"]
    toks = lex("let a = b + 1; console.log(a, 'x');", js)
    assert normalized(toks, js, 0)[:4] == ["let", "a", "=", "b"]
    assert normalized(toks, js, 1)[5] == "$NUM"
    assert normalized(toks, js, 2)[:4] == ["let", "$V0", "=", "$V1"] and "console" in normalized(toks, js, 2)
    assert statements_of(["a", ";", ";", "b", "}", "c"], js) == [["a", ";"], ["b", "}"], ["c"]]


def test_renaming_leaves_units_equal():
    for lang, text in (("javascript", SCRIPT), ("ruby", RUBY), ("csharp", SHARP), ("objc", OBJC)):
        forms = [[u[2:] for u in units_of(text.format(N=a, n=a.lower()), LANGUAGES[lang], Config())] for a in ("User", "Product")]
        assert forms[0] == forms[1] and len(forms[0]) >= 1, lang


def test_ignore_directive_and_thresholds():
    text = SCRIPT.format(N="User", n="user")
    assert not list(units_of(text.replace("  async", "  // kindred-ignore\n  async"), LANGUAGES["javascript"], Config()))
    assert not list(units_of(text, LANGUAGES["javascript"], Config(min_lines=30)))
    assert [u[2] for u in units_of(text, LANGUAGES["javascript"], Config(window_min_function=4))].count("window") > 0
    assert list(units_of("function (", LANGUAGES["javascript"], Config())) == []


def test_scan_of_a_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in (("a/user.ts", SCRIPT), ("b/product.ts", SCRIPT), ("node_modules/x.ts", SCRIPT), ("a/user.rb", RUBY), ("a/product.rb", RUBY), ("a/x.min.js", SCRIPT), ("a/notes.txt", SCRIPT)):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text.format(N=at.stem.title(), n=at.stem))
    cfg = Config()
    files = read_files(spark, [str(root)], cfg)
    assert sorted(r.file for r in files.select("file").collect()) == ["a/product.rb", "a/user.rb", "a/user.ts", "b/product.ts"]
    found = analyze(files, code_units(files, cfg), cfg).findings.where("not suppressed").collect()
    assert {tuple(sorted(r.file for r in f.regions)) for f in found} == {("a/product.rb", "a/user.rb"), ("a/user.ts", "b/product.ts")}
    assert {f.type for f in found} == {"renamed"} and all(f.similarity == 1.0 for f in found)


def test_symlinks_are_skipped_unless_followed(spark, tmp_path):
    root, other = tmp_path / "tree", tmp_path / "other"
    for at in (root / "a.ts", other / "b.ts"):
        at.parent.mkdir()
        at.write_text(SCRIPT.format(N="User", n="user"))
    (root / "link.ts").symlink_to(other / "b.ts")
    (root / "folder").symlink_to(other)
    names = lambda cfg: sorted(r.file for r in read_files(spark, [str(root)], cfg).select("file").collect())
    assert names(Config()) == ["a.ts"] and names(Config(follow_symlinks=True)) == ["a.ts", "link.ts"]
    assert names(Config()) == sorted(r.file for r in read_files(spark, [f"file://{root}"], Config()).select("file").collect())


def test_kinds_of_tokens():
    # numbers of go/token: IDENT 4, INT 5, STRING 9, OR 18, XOR 19, AND 17, ADD 12, ASSIGN 42, LPAREN 49, SEMICOLON 57, COLON 58
    of = lambda text, lang: kinds_of(lex(text, LANGUAGES[lang]), LANGUAGES[lang])
    assert of("x = f(1) + 'a'; y | z & w => 2", "javascript") == [4, 42, 4, 49, 5, 54, 12, 9, 57, 4, 4, 4, 4, 4, 4, 5]
    assert of("x = :s | b & c", "ruby") == [4, 42, 9, 18, 4, 17, 4]
    assert of('a ^ b ~ @"s"', "objc") == [4, 19, 4, 4, 9]
    assert of("a ^ ~b ? c : 1u;", "csharp") == [4, 19, 19, 4, 4, 4, 58, 5, 57]


def test_kinds_of_go_tokens():
    # FUNC 71, RETURN 80, TYPE 84, DEFINE 47, ARROW 36, ELLIPSIS 48, PERIOD 53, FLOAT 6, IMAG 7, CHAR 8, VAR 85
    toks = ["func", "$FUNC", "(", ")", "{", "$V0", ":=", "<-", "$P0", ";", "return", "$INT", "}"]
    assert go_kinds(toks) == [71, 4, 49, 54, 51, 4, 47, 36, 4, 57, 80, 5, 56]
    assert go_kinds(["type", ".", "(", "type", ")", "map", "chan", "interface{}", "var", "..."]) == [84, 53, 49, 4, 54, 4, 4, 4, 85, 48]
    assert go_kinds(["0x1e", "1e3", "1.5", ".5", "12", "2i", '"s"', "`s`", "'c'", "$STR", "$RUNE", "$FLOAT"]) == [5, 6, 6, 6, 5, 7, 9, 9, 8, 9, 8, 6]


def test_units_hold_a_kind_for_each_token(spark, tmp_path):
    (tmp_path / "a.ts").write_text(SCRIPT.format(N="User", n="user"))
    (tmp_path / "b.go").write_text("package p\n\nfunc f(a int) int {\n\tb := a + 1\n\tif b > 2 {\n\t\treturn b\n\t}\n\treturn a\n}\n")
    cfg = Config(hash_family="fnv", window_min_function=3, window_size=2)
    rows = code_units(read_files(spark, [str(tmp_path)], cfg), cfg).collect()
    assert {r.file for r in rows} == {"a.ts", "b.go"} and all(len(r.tokens) == len(r.kinds) == r.n_tokens for r in rows)
    assert {"function", "window"} == {r.kind for r in rows}
    for r in rows:
        assert all(k == 49 for t, k in zip(r.tokens, r.kinds, strict=True) if t == "(")
