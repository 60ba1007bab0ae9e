"""Packed dumps read like one file a document."""

from pathlib import Path

from pyspark.sql import functions as F

from quire.sources import dumps, sinks

FLAT = {"a": '[{"fieldName": "x", "signed": true}, {"type": "T\\n\\"é"}]', "b": "[]", "c": '{"fieldName": "one"}', "d": "[{", "e": '[{"signed": "yes", "type": "kept"}]'}
META = {"a": '{"info": {"Title": "t", "k": "v"}, "xmp": "x"}', "b": '{"xmp": null}', "c": "{}", "d": "{"}
XREF = {"a": '{"entries": [{"objNum": 1, "status": "free"}, {"objNum": 2}]}', "b": '{"entries": []}', "c": "{}"}
TREE = {"a": '{"id": "r", "children": [{"id": "x", "label": "l", "children": [{"id": "z"}]}, {"id": "y"}]}', "b": '{"id": "s", "children": []}'}


def both(spark, tmp_path, texts, read):
    """Rows of the dumps as files and packed, by document."""
    for name, text in texts.items():
        (tmp_path / "files" / name).mkdir(parents=True)
        Path(tmp_path / "files" / name / "dump.txt").write_text(text, encoding="utf-8")
    sinks.write_dumps(spark.createDataFrame(list(texts.items()), "doc_id string, value string").coalesce(1), str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == 1
    files = read(f"{tmp_path}/files/*/*.txt", False).withColumn("doc_id", F.regexp_extract("doc_id", "([^/]+)/dump.txt$", 1))
    packed = read(str(tmp_path / "packed"), True)
    assert files.columns == packed.columns
    plain = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    return plain(files), plain(packed)


def test_packed_index_dumps(spark, tmp_path):
    for kind, texts, n in (("signatures", FLAT, 5), ("metadata", META, 4), ("xref", XREF, 2)):
        files, packed = both(spark, tmp_path / kind, texts, lambda path, p: dumps.read_index_dump(spark, kind, path, p))  # noqa: B023
        assert files == packed and len(packed) == n


def test_packed_tree_dumps(spark, tmp_path):
    files, packed = both(spark, tmp_path, TREE, lambda path, p: dumps.read_tree_dump(spark, path, p))
    assert files == packed and len(packed) == 5
