"""Each command over small folders."""

import pathlib

from strandline import cli
from tests.test_pages import ALTO


def read(folder):
    return {str(p.relative_to(folder)): p.read_text(encoding="utf-8", errors="replace") for p in pathlib.Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def test_commands(spark, tmp_path):
    pages, texts = tmp_path / "pages", tmp_path / "texts"
    pages.mkdir()
    texts.mkdir()
    (pages / "1903-03-15_p.xml").write_text(ALTO, encoding="utf-8")
    (texts / "1903-03-15_p.txt").write_text("Oulujoki jäätyi. Wesi on jäätyw1nen.", encoding="utf-8")
    (texts / "1904-03-15_p.txt").write_text("Ei mitään.", encoding="utf-8")
    out = lambda name: str(tmp_path / "out" / name)
    cli.main(["parse", str(pages), out("parse")])
    assert any("Toinen palsta" in t for t in read(out("parse")).values())
    cli.main(["parse", str(pages), out("kwic"), "--keywords", "palsta"])
    assert any('"position":29' in t or '"keyword":"palsta"' in t for t in read(out("kwic")).values())
    cli.main(["parse", str(pages), out("blocks"), "--blocks"])
    cli.main(["segment", str(pages), out("segment")])
    assert any("boundary_type" in t for t in read(out("segment")).values())
    cli.main(["pipeline", str(pages), out("pipeline")])
    cli.main(["normalize", str(texts), out("normalize"), "--track-changes"])
    assert any("Vesi" in t for t in read(out("normalize")).values())
    cli.main(["correct", str(texts), out("correct"), "--auto-correct", "--rules-only"])
    assert any("jäätywinen" in t for t in read(out("correct")).values())
    cli.main(["correct", str(texts), out("flags"), "--detect-only"])
    cli.main(["extract", str(texts), out("extract")])
    got = read(out("extract"))
    assert any("Oulujoki" in t for n, t in got.items() if n.startswith("results")) and any(n.startswith("texts/source=1903") for n in got)
    cli.main(["flatten", f"{out('extract')}/results", out("flat")])
    assert any(t.startswith("source_file,file_year") and "jäätyi" in t for t in read(out("flat")).values())
    cli.main(["events", str(texts), out("events")])
    assert any("freeze,jäätyi,oulujoki,1903-03-15" in t for t in read(out("events")).values())
    (tmp_path / "e.csv").write_text("binding_id,date,river_hint,event_type,snippet\n1,1890-05-10,kemi,freeze,x\n")
    cli.main(["analyse", str(tmp_path / "e.csv"), out("analyse")])
    assert any("kemi,1890,1,freeze" in t for t in read(out("analyse")).values())


def test_fetch_and_titles(spark, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(pathlib.Path(__file__).parent.parent))
    out = str(tmp_path / "fetch")
    cli.main(["fetch", "http://x/search", out, "--start", "1900-01-01", "--end", "1900-12-31", "--max-results", "3", "--transport", "tests.transports:search"])
    assert len(next(t for n, t in read(out).items() if n.startswith("manifest")).splitlines()) == 4
    cli.main(["fetch", "http://x/search", f"file://{out}", "--resume", "--download", "--transport", "tests.transports:pages"])
    assert sum(n.endswith(".xml") for n in read(out)) == 3
    cli.main(["titles", "http://x/t", str(tmp_path / "titles"), "--language", "sv", "--transport", "tests.transports:titles"])
    assert any(t.startswith("title,issn,language") and "A,1," in t for t in read(tmp_path / "titles").values())
