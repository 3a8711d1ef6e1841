import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep import schemas
from lorekeep.functions.embed import HashingProvider
from lorekeep.operators import fts, incremental, search
from lorekeep.operators.codechunk import chunk_text
from lorekeep.operators.store import Changes, Conflict, Store
from lorekeep.sources import files


def note(i, text="t"):
    return (i, f"{i}.md", "h", text, "", "s", "p", "", 0, [0.0] * 4)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(list(r), schemas.NOTES)
    s.drop("notes")
    assert s.count("notes") == 0 and s.table("notes", schemas.NOTES).count() == 0
    s.upsert("notes", rows(note("a"), note("b")), schemas.NOTES)
    s.upsert("notes", rows(note("a", "new")), schemas.NOTES)
    s.upsert("notes", rows().limit(0), schemas.NOTES)
    assert {r.id: r.text for r in s.table("notes", schemas.NOTES).collect()} == {"a": "new", "b": "t"}
    s.delete_ids("notes", ["a"], schemas.NOTES)
    s.delete_ids("notes", [], schemas.NOTES)
    assert s.count("notes") == 1 and s.vacuum(older_than=-1) == 0
    s.compact("notes")
    assert s.count("notes") == 1 and s.vacuum(older_than=-1) > 0 and s.count("notes") == 1
    s.commit({"x": spark.range(3)})
    assert s.table("x", schemas.NOTES).count() == 0  # lacks columns: made anew
    with s.lock(), pytest.raises(TimeoutError), s.lock(patience=0.1):
        pass
    s.upsert("notes", rows(note("d", "one"), note("d", "two")), schemas.NOTES)
    assert s.table("notes", schemas.NOTES).where("id = 'd'").count() == 1
    s.drop("notes")
    assert not s.exists("notes")
    (tmp_path / "store" / ".manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "store" / "manifest.json").write_text("{broken")
    assert s.manifest() == {}


def test_writers_side_by_side(spark, tmp_path):
    """A commit that another one overtakes is made again on what that one left; a writer that is overtaken each time gives up."""
    a, b = (Store(spark, str(tmp_path / "st")) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([note(i) for i in ids], schemas.NOTES)
    a.upsert("notes", rows("x"), schemas.NOTES)
    seen = []

    def make(now):
        n = now.count("notes")
        seen.append(n)
        if len(seen) == 1:
            b.upsert("notes", rows("y"), schemas.NOTES)
        return Changes(replace={"notes": now.rows("notes").unionByName(rows(f"z{n}"))})

    a.transact(make)
    assert seen == [1, 2] and sorted(r.id for r in a.table("notes", schemas.NOTES).collect()) == ["x", "y", "z2"]
    with pytest.raises(Conflict):
        a.transact(lambda _: b.upsert("notes", rows("w"), schemas.NOTES) or Changes(replace={"other": rows("v")}), tries=2)
    assert not a.exists("other")


def test_segments(spark, tmp_path):
    """Rows that were deleted and come back count; compaction changes nothing."""
    s = Store(spark, str(tmp_path / "st"))
    rows = lambda *xs: spark.createDataFrame([note(*x) for x in xs], schemas.NOTES)
    for step in ([("a", "1"), ("b", "1")], [("a", "2")], [("c", "3"), ("b", "3")]):
        s.upsert("notes", rows(*step), schemas.NOTES)
    s.delete_ids("notes", ["a", "c"], schemas.NOTES)
    s.upsert("notes", rows(("a", "5")), schemas.NOTES)
    text = lambda: {r.id: r.text for r in s.table("notes", schemas.NOTES).collect()}
    assert text() == {"a": "5", "b": "3"} and len(s.now().tables["notes"]["segments"]) == 4
    s.compact("notes")
    assert text() == {"a": "5", "b": "3"} and len(s.now().tables["notes"]["segments"]) == 1


def test_vault(spark, tmp_path):
    v, s = tmp_path / "vault", Store(spark, str(tmp_path / "st"))
    (v / ".obsidian").mkdir(parents=True)
    (v / "_sub").mkdir()
    (v / "a.md").write_text("## One\nalpha\n\n## Two\nbeta and more\n")
    (v / "_sub" / "b.md").write_text("## Three\ngamma\n")
    (v / ".obsidian" / "x.md").write_text("no")
    (v / "c.txt").write_text("no")
    scan = lambda: files.vault(spark, [str(v)])
    e = HashingProvider(384)
    assert incremental.index_notes(s, scan(), e) == (2, 3, 0) and incremental.index_notes(s, scan(), e) == (0, 0, 0)
    (v / "a.md").write_text("## One\ndelta\n")
    assert incremental.index_notes(s, scan(), e) == (1, 1, 0)
    t = s.table("notes", schemas.NOTES)
    assert sorted(r.heading for r in t.collect()) == ["One", "Three"]  # old chunks of an edited note are gone
    assert [r.heading for r in search.search_notes(t, "delta", mode="hybrid", embedder=e, top_k=1).collect()] == ["One"]
    (v / "_sub" / "b.md").unlink()
    assert incremental.index_notes(s, scan(), e) == (0, 0, 1) and s.count("notes") == 1
    # the stored index follows: the same hits as from the texts
    t, index = s.table("notes", schemas.NOTES), fts.stored(s.now(), "notes")
    assert index.corpus.first().n == 1 and index.postings.count() == 2
    hits = [[(r.heading, round(r.score, 9)) for r in search.search_notes(t, "delta gamma alpha", index=x).collect()] for x in (index, None)]
    assert hits[0] == hits[1] and hits[0][0][0] == "One"


def test_repos(spark, tmp_path):
    top, s = tmp_path / "code", Store(spark, str(tmp_path / "st"))
    for name in ("app", "app2"):
        (top / name / "node_modules").mkdir(parents=True)
        (top / name / "main.py").write_text("import os\n\ndef main():\n    pass\n")
        (top / name / "__init__.py").write_text("X = 1\n")
        (top / name / "node_modules" / "p.py").write_text("no = 1")
        (top / name / "data.py").write_bytes(b"a\0b")
        (top / name / "big.py").write_text("x" * 100_001)
        (top / name / "skip.py").write_text("y = 1")
        (top / name / ".gitignore").write_text("skip.py\n")
    scan = files.repos(spark, [str(top)])
    assert sorted((r.repo_name, r.rel_path) for r in scan.collect()) == [("app", "__init__.py"), ("app", "main.py"), ("app2", "__init__.py"), ("app2", "main.py")]
    assert incremental.index_code(s, scan, HashingProvider(8)) == (4, 6, 0)
    assert incremental.index_code(s, scan) == (0, 0, 0)
    only = files.repos(spark, [str(top / "app")])
    (top / "app" / "main.py").write_text("def other():\n    pass\n")
    assert incremental.index_code(s, only, HashingProvider(8), within=str(top / "app")) == (1, 1, 0)
    assert s.table("code", schemas.CODE).where("repo_name = 'app2'").count() == 3  # a sibling is left alone
    assert [r.symbol_name for r in search.search_code(s.table("code", schemas.CODE), "other").collect()] == ["other"]


@pytest.mark.parametrize(
    "rules,rel,want",
    [("*.py", "a/b.py", True), ("/b.py", "a/b.py", False), ("a/", "a/b.py", True), ("*.py\n!b.py", "a/b.py", False), ("a/**/c.py", "a/x/y/c.py", True), ("# c\n\nx?.py", "xy.py", True), ("[ab].py", "c.py", False)],
)
def test_ignore(rules, rel, want):
    assert files.Ignore(rules)(rel) is want


def test_patterns():
    assert files.wanted("x/a.md") and not files.wanted(".obsidian/a.md") and files.wanted(".obsidian/a/b.md") and not files.wanted("a.txt")


PY = "import json\nfrom pathlib import Path\n\n# where letters lie\nclass Drawer:\n    def put(self, letter):\n        return letter\n\n@cache\ndef label(): pass\n\ndef sort_by_date(letters, newest):\n    return letters\n\nLIMIT = 40\n"
SOURCES = {
    "python": PY + "try:\n    pass\nexcept OSError as e:\n    raise\nelse:\n    x = 'é' * 3; y = 2\n",
    "csharp": "using A;\nusing B.C;\nnamespace Post.Office {\n  // stamps\n  public class Stamp { public int Worth { get; set; }\n    public int Twice(int n) { return n * 2; } }\n  enum Colour { Red, Blue }\n}\n",
    "typescript": "import { post } from './post';\nimport mail from 'mail';\n\nexport interface Letter { to: string }\nexport class Box {\n  open() { return '}'; }\n  private shut(n: number) { if (n) { return 1; } return 2; }\n}\nfunction send(n: number) { return n; }\nconst weigh = () => { return 1; };\nenum Size { S, L }\n",
    "tsx": "export function Stamp() {\n  return <i>{'a'}</i>;\n}\n",
    "css": "@import 'post.css';\n.stamp { color: red; }\n/* edge */\n@media print { .edge { top: 0; } .back { top: 1px; } }\n",
    "html": "<!DOCTYPE html><html><style>p{}</style><body><p>Stamps<br>and <b>letters</p><!-- x --><script>var a = '</p>';</script></body></html> tail",
}


def test_python_chunks():
    rows = [(k, name, sig) for _, k, name, _, sig, *_ in chunk_text(PY, "python", "f.py")]
    assert rows == [("imports", "", ""), ("other", "", ""), ("class", "Drawer", "class Drawer:"), ("function", "label", "@cache"), ("function", "sort_by_date", "def sort_by_date(letters, newest):"), ("other", "", "")]
    big = "class Shelf:\n" + "".join(f"    def row{i}(self):\n        return {i}\n\n" for i in range(60))
    parts = chunk_text(big, "python", "f.py", 500)
    assert len(parts) == 61 and {p[3] for p in parts} == {"Shelf"} and [p[2] for p in parts[1:]] == [f"row{i}" for i in range(60)] and parts[7][7:9] == (20, 21)
    assert chunk_text("", "python", "f") == [] and chunk_text("# T", "markdown", "f") == [] and len(chunk_text("def broken(:\n  x\n\ny", "python", "f")) == 2


def test_other_languages():
    kinds = lambda lang, most=1500: [(r[1], r[2], r[3]) for r in chunk_text(SOURCES[lang], lang, "f", most)]
    assert kinds("csharp") == [("imports", "", ""), ("other", "", "Post.Office"), ("other", "", "Post.Office"), ("class", "Stamp", "Post.Office"), ("other", "Colour", "Post.Office")]
    assert [k for k in kinds("csharp", 60) if k[0] == "function"] == [("function", "Twice", "Stamp")]
    assert kinds("typescript") == [("imports", "", ""), ("class", "Letter", ""), ("class", "Box", ""), ("function", "send", ""), ("other", "", ""), ("other", "Size", "")]
    assert [k for k in kinds("typescript", 70) if k[0] == "function"] == [("function", "open", "Box"), ("function", "shut", "Box"), ("function", "send", "")]
    assert kinds("tsx") == [("function", "Stamp", "")] and [k[0] for k in kinds("css")] == ["imports", "other", "other", "other"]
    rows = chunk_text(SOURCES["html"], "html", "f.html")
    assert [r[1] for r in rows] == ["imports", "other", "other"] and "Stamps" in rows[1][5] and rows[2][5] == "tail"


def _bare(parts):
    return "".join("".join(parts).split())


PIECES = ["}", "{", "<p>", "</p>", "\n\n", "é" * 90, "'", "/*", "x = 1\n", "class Q:\n  def f(self):\n    pass\n", "\r\n", '"', "(", "@a\n", "<b", "🙂 "]


@settings(deadline=None, max_examples=300)
@given(st.sampled_from(sorted(SOURCES)), st.lists(st.tuples(st.integers(0, 400), st.sampled_from(PIECES)), max_size=6), st.sampled_from([20, 80, 1500]))
def test_no_text_is_lost(lang, more, most):
    text = SOURCES[lang]
    for at, piece in more:
        text = text[:at] + piece + text[at:]
    rows = chunk_text(text, lang, "f", most)
    assert _bare(r[5] for r in rows) == _bare([text])
    assert all(len(r[5].encode()) <= most + r[5].count("\n") for r in rows) and [r[9] for r in rows] == list(range(len(rows)))


def test_large_leaves_are_cut():
    ts = "class Long {\n  run() {\n" + "    call(1, 2, 3);\n" * 300 + "  }\n}\n"
    py = "text = '" + "letters of a long literal " * 130 + "'\n"
    deep = "<div>" * 4000 + "x" + "</div>" * 4000
    for text, lang in ((ts, "typescript"), (py, "python"), (deep, "html"), ("x" * 9000, "css")):
        rows = chunk_text(text, lang, "f")
        assert len(rows) > 1 and _bare(r[5] for r in rows) == _bare([text]) and all(len(r[5]) <= 1500 for r in rows)


def test_pages_keep_their_text(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert _bare(c[5] for c in chunk_text(r.html or "", "html", "f")) == _bare([r.html or ""])


def test_notes_sink(spark, tmp_path):
    df = spark.createDataFrame([("x/a.md", "one")], "rel_path string, body string")
    files.write_notes(df, str(tmp_path))
    files.write_notes(df, str(tmp_path), append=True)
    assert (tmp_path / "x" / "a.md").read_text() == "oneone"


def test_sql_function(spark):
    from lorekeep.operators.codechunk import ChunkCode

    spark.udtf.register("chunk_code", ChunkCode)
    spark.createDataFrame([("def f():\n    pass\n", "python", "f.py")], "content string, language string, path string").createOrReplaceTempView("files")
    assert spark.sql("SELECT c.symbol_name FROM files, LATERAL chunk_code(content, files.language, path) c").first()[0] == "f"
