"""The Go front end on forms of the language, and the settings and paths around it."""

import pytest

from kindred.config import Config, discover, load
from kindred.sources.examples import GO
from kindred.sources.golang import go_units

LOOSE = Config(min_statements=1, min_lines=1, window_min_function=99)


def _form(body: str, level: str = "strong", signature: str = "func f()") -> str:
    units = list(go_units(f"package p\n{signature} {{\n{body}\n}}\n", Config(min_statements=1, min_lines=1, window_min_function=99, level=level)))
    assert len(units) == 1, units
    return " ".join(units[0][6]).split(" { ", 1)[1].removesuffix(" }")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("x, err := a.B(1, 'c', 2.5)", "$V0 , $V1 := $V2 . B ( $INT , $RUNE , $FLOAT )"),
        ("for {\n}", "for { }"),
        ("for ok {\n}", "for $V0 ; { }"),
        ("for i := 0; i < 3; i++ {\n}", "for $V0 := $INT ; $V0 < $INT ; $V0 ++ { }"),
        ("for range c {\n}", "for ILLEGAL range $V0 { }"),
        ("if v, ok := m[k]; ok {\n} else if v {\n} else {\n}", "if $V0 , $V1 := $V2 [ $V3 ] ; $V1 { } else if $V0 { } else { }"),
        ("switch t := x.(type) {\ncase int, *T:\n\tf(t)\ndefault:\n}", "switch $V0 := $V1 . ( type ) { case $V2 , * $V3 : $V4 ( $V0 ) case : }"),
        ("select {\ncase v := <-c:\n\tg(v)\ncase d <- 1:\n}", "select { case $V0 := <- $V1 : $V2 ( $V0 ) case $V3 <- $INT : }"),
        ("var a, b int = 1, 2", "var $V0 , $V1 int = $INT = $INT"),
        ("p := &Point{X: 1, Y: q.Z}", "$V0 := & Point { $V1 : $INT , $V2 : $V3 . Z }"),
        ("s := []T{{1}, {2}}\ns = s[1:n]", "$V0 := [ ] T { { $INT } , { $INT } } $V0 = $V0 [ $INT : $V1 ]"),
        ("m := map[string]chan int{}", "$V0 := map [ string ] chan int { }"),
        ("defer func(a int) error { return nil }(1)", "defer func ( $P0 int ) ( error ) { return nil } ( $INT )"),
        ("again:\nfor {\n\tcontinue again\n}", "$LABEL0 : for { continue }"),
        ("type T struct {\n\ta int\n}\nvar x interface{ M() }", "type $V0 struct{} var $V1 interface{}"),
        ("f(a...) // not this\n/* nor\nthis */ g()", "$V0 ( $V1 ... ) $V2 ( )"),
        ("x := `raw\n\"string\"` + \"}\"", "$V0 := $STR + $STR"),
    ],
)
def test_forms(body, want):
    assert _form(body) == want


def test_levels_keep_what_they_should():
    assert _form('err := a.B("x")', "light") == "err := a . B ( $STR )" and _form('err := a.B("x")', "raw") == 'err := a . B ( "x" )'


def test_units_regions_windows_and_unreadable_functions():
    total = list(go_units(GO, Config()))
    assert [u[:6] for u in total] == [("Total", "*Shop", "function", 4, 17, 4)]  # the other one is ignored by its comment
    body = "\n".join(f"a{i}(x)" for i in range(8))
    text = f"package p\n\nfunc broken() {{ := }}\n\nfunc Map[K any, V any](x K) {{\n{body}\n}}\n"
    units = list(go_units(text, Config()))
    assert [(u[2], u[3], u[4], u[5]) for u in units] == [("function", 5, 14, 8), *(("window", 6 + i, 10 + i, 5) for i in range(4))]
    assert units[2][6][:4] == ["$V0", "(", "$V1", ")"]  # a window counts its names afresh
    assert list(go_units("", Config())) == [] and list(go_units("func f() {", Config())) == []


def test_settings_files_may_have_sections_and_lists(tmp_path, monkeypatch):
    at = tmp_path / ".kindred.yaml"
    at.write_text("# ours\nversion_note:\n")
    with pytest.raises(ValueError, match="not a setting"):
        (tmp_path / "bad").write_text("nonsense\n")
        load(str(tmp_path / "bad"))
    at.write_text("---\nanalysis:\n  min_statements: 5  # more\n  level: light\nscoring:\n  min_score: 0.5\ndiscovery:\n  exclude:\n    - '**/a.go'\n    - b/**\n")
    monkeypatch.chdir(tmp_path)
    assert discover() == ".kindred.yaml"
    c = load()
    assert (c.min_statements, c.level, c.min_score, c.exclude) == (5, "light", 0.5, ("**/a.go", "b/**"))


def test_directories_and_numbers(spark):
    from pyspark.sql import functions as F

    from kindred.operators.units import numbered
    from kindred.plans.session import common_directory, stripped

    def of(*paths):
        return common_directory(spark.createDataFrame([(p,) for p in paths], "p string"), "p").first().directory

    assert of("a/b/x", "a/b/c/y", "a/b-1/z") == "a/" and of("a/b/x", "a/b/y") == "a/b/" and of("a/bc/x", "a/b/y") == "a/"
    assert of("x", "y") == "" and of("/r/a", "/r/b") == "/r/" and of("a/x", "b/y") == ""
    assert [r[0] for r in spark.createDataFrame([("a/b",), ("c",)], "p string").select(stripped(F.col("p"), "a/")).collect()] == ["b", "c"]
    assert spark.range(1).select(numbered(F.lit(3), F.lit(1))).first()[0] == 3 * 2**20 + 1
    with pytest.raises(Exception, match="exceed"):
        spark.range(1).select(numbered(F.lit(3), F.lit(1 << 20))).collect()
