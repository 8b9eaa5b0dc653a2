"""Run folders as tables."""

from __future__ import annotations

import json

from newsloom.sources import runs


def _folder(root, name, **files):
    (root / name).mkdir(parents=True)
    for k, v in files.items():
        stem, kind = k.rsplit("_", 1)
        (root / name / f"{stem}.{kind}").write_text(v if isinstance(v, str) else json.dumps(v))


def test_runs_are_imported_once_and_replaced(spark, tmp_path):
    _folder(
        tmp_path, "run-1",
        candidates_json=[{"candidate_id": "a", "title": "A"}, {"candidate_id": "a", "title": "A2"}, {"title": "no id"}, 3], rejected_candidates_json=[{"candidate_id": "a", "title": "R"}], claims_json="not json",
        raw_sources_jsonl='{"source_id": "s"}\n\n{"source_id": "t"}\n', stories_json=[], other_json=[{"id": 1}],
    )
    _folder(tmp_path, "run-2", stories_json=[{"story_id": "x", "title": "X", "theme_section": "pc"}])
    folders, root = [str(tmp_path / "run-1"), str(tmp_path / "run-2")], str(tmp_path / "store")
    want = {("run-1", "candidates"): 3, ("run-1", "raw_sources"): 2, ("run-2", "stories"): 1}
    for _ in range(2):  # again changes nothing
        assert {(r.run_id, r.table_name): r.n for r in runs.import_runs(spark, folders, root).collect()} == want
        held = spark.read.parquet(f"{root}/candidates").collect()
        assert {(r.lane, r.title) for r in held} == {("main", "A2"), ("main", "no id"), ("rejected", "R")} and {r.run_id for r in held} == {"run-1"}
    (tmp_path / "run-2" / "stories.json").write_text(json.dumps([{"story_id": "y", "title": "Y"}]))
    runs.import_runs(spark, folders[1:], root).collect()
    assert [(r.item_id, r.title) for r in spark.read.parquet(f"{root}/stories").collect()] == [("y", "Y")]
    assert spark.read.parquet(f"{root}/candidates").count() == 3


def test_manifest(spark, tmp_path):
    _folder(tmp_path, "r", candidates_json=[], claims_json=[1])
    got = {r.file_name: (r.stage, r.exists, r.size_bytes) for r in runs.manifest(spark, [str(tmp_path)], {"collect": ["candidates.json", "raw.json"], "verify": ["claims.json"]}).collect()}
    assert got == {"candidates.json": ("collect", True, 2), "raw.json": ("collect", False, 0), "claims.json": ("verify", True, 3)}
