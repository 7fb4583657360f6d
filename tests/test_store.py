import io
import tarfile
import zipfile

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from taxaloom.operators import taxonomy
from taxaloom.sources import archive, files, taxdump


def line(*fields):
    return "\t|\t".join(map(str, fields)) + "\t|\n"


def texts(extra=""):
    return {
        "names.dmp": line(1, "root", "", "scientific name") + line(2, "Alpha", "", "scientific name") + line(3, f"Alpha beta{extra}", "", "scientific name"),
        "nodes.dmp": line(1, 1, "no rank", "x") + line(2, 1, "genus", "") + line(3, 2, "species"),
        "merged.dmp": line(33, 3),
    }


def folder(path, extra="", inner="a/b"):
    for name, text in texts(extra).items():
        (path / inner).mkdir(parents=True, exist_ok=True)
        (path / inner / name).write_text(text)
    return str(path)


def rows(tables, *names):
    return {n: sorted(map(str, tables[n].collect())) for n in names or ("names", "nodes", "merged")}


def test_a_build_that_ends_early_changes_nothing(spark, tmp_path, monkeypatch):
    store, write = str(tmp_path / "store"), DataFrameWriter.parquet
    taxdump.build(spark, folder(tmp_path / "one"), store, "2020", "r1")
    first = taxdump.open_store(spark, store)
    before = rows(first, "names", "nodes", "merged", "meta")
    second = folder(tmp_path / "two", " gamma")
    for fatal in range(1, 20):
        calls = []

        def dies(self, path, *args, **kwargs):
            if "versions" in path:
                calls.append(path)
                if len(calls) == fatal:
                    raise KeyboardInterrupt
            return write(self, path, *args, **kwargs)

        monkeypatch.setattr(DataFrameWriter, "parquet", dies)
        try:
            taxdump.build(spark, second, store, "2021", "r2")
            break
        except KeyboardInterrupt:
            assert rows(taxdump.open_store(spark, store), "names", "nodes", "merged", "meta") == before
    assert fatal == 6  # names, nodes, merged, labelled nodes and meta were each the last
    monkeypatch.undo()
    now = taxdump.open_store(spark, store)
    assert now["meta"].first().release == "r2" and any("gamma" in r for r in rows(now)["names"])
    assert rows(first, "names", "nodes", "merged", "meta") == before  # readers of the first keep it
    assert taxdump.prune(spark, store, abandoned=True) == 5  # the first build and four that had written something
    assert rows(taxdump.open_store(spark, store)) == rows(now)


def test_not_committed_is_not_there(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    monkeypatch.setattr(files, "create_empty", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        taxdump.build(spark, folder(tmp_path / "one"), store, "2020")
    with pytest.raises(FileNotFoundError):
        taxdump.open_store(spark, store)


def test_archives_equal_folders(spark, tmp_path):
    meta = taxdump.build(spark, folder(tmp_path / "plain"), str(tmp_path / "s0"), "2020").first()
    assert (meta.names, meta.nodes, meta.merged, [f.file for f in meta.files]) == (3, 3, 1, ["merged.dmp", "names.dmp", "nodes.dmp"]) and all(len(f.sha256) == 64 for f in meta.files)
    want = rows(taxdump.open_store(spark, str(tmp_path / "s0")))
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "x")
        for name, text in texts().items():
            z.writestr(f"in/{name}", text)
    for name, mode in (("d.tar.gz", "w:gz"), ("d.tgz", "w:gz"), ("d.tar", "w")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member, text in {"readme.txt": "x", **texts()}.items():
                info = tarfile.TarInfo(f"in/{member}")
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
    for k, name in enumerate(("d.zip", "d.tar.gz", "d.tgz", "d.tar")):
        store = str(tmp_path / f"a{k}")
        built = taxdump.build(spark, str(tmp_path / name), store, "2020").first()
        assert [f.file for f in built.files] == [name]
        assert rows(taxdump.open_store(spark, store)) == want
    found = archive.read_archive(spark, str(tmp_path / "d.zip"), "*.dmp")
    assert found.rdd.getNumPartitions() == 3
    assert found.groupBy("member").count().count() == 3 and found.where("member = 'in/nodes.dmp'").orderBy("line").first().value == texts()["nodes.dmp"].split("\n")[0]
    assert "readme.txt" in archive.members(str(tmp_path / "d.zip"))


def test_missing_files(spark, tmp_path):
    one = folder(tmp_path / "one")
    (tmp_path / "one/a/b/merged.dmp").unlink()
    assert taxdump.build(spark, one, str(tmp_path / "s"), "2020").first().merged == 0
    (tmp_path / "one/a/b/nodes.dmp").unlink()
    with pytest.raises(FileNotFoundError, match="nodes.dmp"):
        taxdump.build(spark, one, str(tmp_path / "s"), "2020")
    assert taxdump.open_store(spark, str(tmp_path / "s"))["nodes"].count() == 3


def test_ancestors_use_the_stores_labels(spark, tmp_path):
    taxdump.build(spark, folder(tmp_path / "one"), str(tmp_path / "s"), "2020")
    nodes = taxdump.open_store(spark, str(tmp_path / "s"))["nodes"]
    assert {"depth", "low", "high"} <= set(nodes.columns)
    assert sorted((r.tax_id, r.ancestor, r.depth) for r in taxonomy.ancestors(nodes.where("tax_id = 3"), nodes).collect()) == [(3, 1, 2), (3, 2, 1), (3, 3, 0)]
