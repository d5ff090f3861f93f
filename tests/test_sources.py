"""Files, pairs, alignments, vectors, sharded lines, the index stream, the command line."""

import gzip
import json

import pytest

from palimpsest.__main__ import main
from palimpsest.sources import files
from palimpsest.streaming.index import build_index, latest, write_state


def test_discovery_and_load(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.TXT").write_bytes(b"Hello\xff  world\r\n\r\n\r\nTwo")
    (tmp_path / "sub" / "a.md").write_text("# Title\n\nGamma delta")
    (tmp_path / "c.csv").write_text("no")
    found = files.load(spark, str(tmp_path), (".txt", ".md")).orderBy("path").collect()
    assert [(r.file_type, r.text) for r in found] == [("txt", "Hello world\n\nTwo"), ("md", "# Title\n\nGamma delta")]
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path), (".exe",))


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("source_doc,susp_doc,label,genre\na,b,yes,essay\nc,d,no,\n")
    rows = files.labelled_pairs_csv(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.left_text, r.label, r.metadata) for r in rows] == [("plagbench:0", "a", True, {"genre": "essay"}), ("plagbench:1", "c", False, {})]
    assert files.labelled_pairs_csv(spark, str(path), limit=1).count() == 1


def test_alignment(spark, tmp_path):
    (tmp_path / "suspicious-document1.txt").write_text("text one")
    (tmp_path / "suspicious-document2.txt").write_text("text two")
    (tmp_path / "suspicious-document1.xml").write_text('<document><feature name="about" authors="x"/><feature name="plagiarism" type="artificial" this_offset="1" this_length="3" source_reference="s.txt" source_offset="5" source_length="4"/></document>')
    rows = {r.file: r for r in files.annotated_documents(spark, str(tmp_path)).collect()}
    assert len(rows["suspicious-document1"].annotations) == 1 and rows["suspicious-document2"].annotations == []
    pair = files.annotated_pairs(files.annotated_documents(spark, str(tmp_path))).first()
    assert pair.source_reference == "s.txt" and pair.annotations[0].this_offset == 1
    (tmp_path / "pairs").write_text("susp1.txt src1.txt\n\nsusp2.txt src2.txt\n")
    assert files.alignment_pairs(spark, str(tmp_path / "pairs"), 1).first().source == "src1.txt"


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "d", "d:0", 0, 5, [1.0, 0.0])], files.VECTOR)
    files.write_vectors(df, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).collect() == df.collect()


def test_sharded_lines_resume(spark, tmp_path):
    for shard in range(2):
        with gzip.open(tmp_path / f"s{shard}.json.gz", "wt") as f:
            f.writelines(json.dumps({"text": f"t{shard}-{i}", "source": "x"}) + "\n" for i in range(3))
    rows = files.sharded_lines(spark, str(tmp_path), after=(0, 2)).orderBy("shard", "line").collect()
    assert [(r.id, r.text) for r in rows] == [("corpus-train-00000-000000002", "t0-2")] + [(f"corpus-train-00001-{i:09d}", f"t1-{i}") for i in range(3)]


def test_index_stream_is_resumable(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    text = " ".join(f"w{i}" for i in range(90))
    (tmp_path / "in" / "1.json").write_text(json.dumps({"text": text, "source": "x"}) + "\n" + json.dumps({"text": "too short", "source": "x"}) + "\n")
    state = build_index(spark, source, target, checkpoint)
    assert state["status"] == "complete" and state["lines"] == 2
    (tmp_path / "in" / "2.json").write_text(json.dumps({"text": text, "source": "x"}) + "\n" + json.dumps({"text": text + " more", "source": "y"}) + "\n")
    assert build_index(spark, source, target, checkpoint)["lines"] == 2
    assert build_index(spark, source, target, checkpoint)["status"] == "no_new_input"
    rows = latest(spark, target).collect()
    assert len(rows) == 2 and all(len(r.vector) == 64 for r in rows)
    write_state(state, str(tmp_path / "state"))
    assert json.loads((tmp_path / "state" / "latest.json").read_text())["lines"] == 2


def test_command_line(spark, tmp_path, capsys):
    shared = "The quick brown fox jumps over the lazy dog near the river bank."
    (tmp_path / "submitted.txt").write_text(f"An opening line of its own.\n\n{shared}")
    (tmp_path / "source.txt").write_text(shared)
    out = tmp_path / "r.json"
    assert main(["scan", str(tmp_path / "submitted.txt"), str(tmp_path / "source.txt"), "--output", str(out), "--html", str(tmp_path / "r.html")]) == 0
    report = json.loads(out.read_text())
    assert {m["kind"] for m in report["matches"]} == {"exact_token_sequence", "exact_overlap"} and report["source_document_id"] == "source"
    assert "quick brown" not in (tmp_path / "r.html").read_text() and "quick brown" not in out.read_text()
    assert main(["scan", str(tmp_path / "none.txt"), str(tmp_path / "source.txt")]) == 1
