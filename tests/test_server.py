import io
import json
import logging
import os

import pytest

from kindred import VERSION
from kindred.__main__ import main
from kindred.config import Config, load
from kindred.plans.logs import set_up
from kindred.plans.server import Scans, answer, serve
from kindred.sources.files import read_files
from kindred.sources.guard import Guard, Refused

FUNC = """class {n} {{
  load{n}(id) {{
    const row = this.repo.find(id, "{n}");
    if (!row) {{
      throw new Error("none");
    }}
    this.log.info(id);
    this.cache.set(id, row, [1, 2, 3, 4, 5, 6, 7, 8], [row, id, row, id]);
    return row.{n};
  }}
}}
"""


@pytest.fixture
def tree(tmp_path):
    for name in ("src/a/User.js", "src/b/Item.js"):
        at = tmp_path / name
        at.parent.mkdir(parents=True)
        at.write_text(FUNC.format(n=at.stem))
    return tmp_path


def _call(scans, tool, **arguments):
    return answer(scans, {"id": 7, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})


def _text(said):
    return said["result"]["content"][0]["text"]


def test_a_session(spark, tree):
    scans = Scans(spark, Config(), Guard([str(tree)], 1 << 20))
    said = _text(_call(scans, "scan", paths=[str(tree)]))
    first, *rest = said.splitlines()
    assert first.startswith("2 files 2 funcs ") and first.endswith("ms | 1 clones | sid:scan-1")
    assert rest[0].startswith("#1 0.") and rest[0].endswith(" RN 2r →EH")
    assert rest[1:] == ["  a/User.js:2-10 loadUser", "  b/Item.js:2-10 loadItem"]
    page = _text(_call(scans, "list_findings", scan_id="scan-1")).splitlines()
    found = page[0].split()[1]
    assert found.startswith("F-") and len(found) == 12 and len(page) == 3
    assert _text(_call(scans, "list_findings", scan_id="scan-1", offset=1)) == "No findings match criteria."
    short, whole = (_text(_call(scans, "explain_finding", scan_id="scan-1", finding_id=found, verbose=v)) for v in (False, True))
    assert "  src/a/User.js:2-10 loadUser" in short and "hint: EH 75% extract_helper" in short and "only 2 members(×0.9)" in short
    assert ("set verbose:true" in short) != ("set verbose:true" in whole)
    both = _text(_call(scans, "compare_regions", file_a="src/a/User.js", start_line_a=1, end_line_a=1, file_b=f"{tree}/src/b/Item.js", start_line_b=10, end_line_b=99))
    assert both == "A User.js:1-1\nclass User {\n\nB Item.js:10-99\n  }\n}\n\n"
    assert "0 files" in _text(_call(scans, "scan", paths=[str(tree / "none")])) and "scan-2" in scans.results


@pytest.mark.parametrize(
    ("tool", "arguments", "text"),
    [("list_findings", {"scan_id": "scan-9"}, "scan_id not found"), ("explain_finding", {}, "scan_id not found"), ("scan", {"paths": ["/"]}, "outside all roots"), ("compare_regions", {"file_a": "/etc/passwd", "end_line_a": 9}, "no scan has this file")],
)
def test_errors_of_tools(spark, tree, tool, arguments, text):
    said = _call(Scans(spark, Config(), Guard([str(tree)], 1)), tool, **arguments)
    assert said["result"]["isError"] and text in _text(said)


def test_protocol():
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "ping"}, {"id": 4, "method": "nope"}, {"method": "nope"},
           {"id": 5, "method": "tools/call", "params": {"name": "nope"}}, {"id": 6, "method": "tools/call", "params": {"name": "scan", "arguments": {"min_score": "x"}}},
           {"id": 8, "method": "tools/call", "params": {"name": "list_findings", "arguments": {"limit": True}}}, {"id": 9, "method": "tools/call", "params": [1]}]
    out = io.StringIO()
    serve(Scans(None, Config()), ["not json\n", "[1]\n", "\n", *(json.dumps(x) + "\n" for x in ask)], out)
    said = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    assert list(said) == [1, 2, 3, 4, 5, 6, 8, 9]
    assert said[1]["result"]["protocolVersion"] == "2024-11-05" and said[3]["result"] == {}
    assert [t["name"] for t in said[2]["result"]["tools"]] == ["scan", "list_findings", "explain_finding", "compare_regions"]
    assert [said[i]["error"]["code"] for i in (4, 5, 6, 8, 9)] == [-32601, -32601, -32602, -32602, -32602]


def test_guard(tmp_path):
    root, other = tmp_path / "root", tmp_path / "rooted"
    for d in (root, other):
        d.mkdir()
        (d / "f").write_text("x")
    os.symlink(root / "f", root / "in")
    os.symlink(other / "f", root / "out")
    os.symlink(root / "gone", root / "dangling")
    g, follow = Guard([str(root)], 10), Guard([str(root)], 10, True)
    for ok in (root, root / "f", root / "a" / ".." / "f"):
        g.path(str(ok))
    for bad in (other / "f", root / ".." / "rooted" / "f", tmp_path):
        with pytest.raises(Refused):
            g.path(str(bad))
    os.symlink(other, root / "way")
    g.path(str(root / "way" / "f"))
    g.resolved(str(root / "in"))
    g.resolved(str(root / "none"))
    for bad in (root / "way" / "f", root / "out", other):
        with pytest.raises(Refused):
            g.resolved(str(bad))
    g.symlink(str(root / "f"))
    follow.symlink(str(root / "in"))
    for guard, name in ((g, "in"), (g, "dangling"), (g, "none"), (follow, "out"), (follow, "dangling")):
        with pytest.raises(Refused):
            guard.symlink(str(root / name))
    g.size(10)
    for make in (lambda: g.size(11), lambda: Guard([], 1), lambda: Guard([str(tmp_path / "none")], 1)):
        with pytest.raises(Refused):
            make()


def test_roots_relative_or_missing(spark, tree, monkeypatch):
    monkeypatch.chdir(tree)
    names = lambda *roots: sorted(r.file for r in read_files(spark, list(roots), Config()).collect())
    assert names(f"file://{tree}/src/") == names(f"{tree}/src") == ["a/User.js", "b/Item.js"]
    assert names(f"{tree}/none") == [] and names(f"{tree}/none", f"{tree}/src/a") == ["User.js"]


def test_logs_and_settings(tmp_path, capsys):
    out = io.StringIO()
    log = set_up("warning", "JSON", out)
    log.info("no")
    log.warning("yes")
    assert json.loads(out.getvalue())["msg"] == "yes" and len(log.handlers) == 1
    assert set_up("odd").level == logging.INFO
    (tmp_path / "c.yaml").write_text("logging:\n  level: error\n  format: json\nanalysis:\n  level: light\n")
    cfg = load(str(tmp_path / "c.yaml"))
    assert (cfg.log_level, cfg.log_format, cfg.level, cfg.format) == ("error", "json", "light", "text")
    assert main(["version"]) == 0 and VERSION in capsys.readouterr().out
