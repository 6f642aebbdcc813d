"""Evaluation files: checked as a whole, or adapted row by row."""

import json

import pytest

from spindrift.operators import loading

ROW = {
    "schema_version": 1, "eval_task": "lvbench", "benchmark": "lvbench", "split": "test", "sample_id": "s1", "problem": "What?", "problem_type": "qa", "source": "web",
    "answer": {"time": [1, 2], "note": "n"}, "images": [], "videos": ["media/video_qa/lvbench/videos/a.mp4"], "metadata": {"year": 7, "question": "never"},
}


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_valid_rows_are_loaded_and_faults_told(spark, tmp_path):
    path = write(tmp_path / "rows.jsonl", [ROW, {**ROW, "sample_id": "s2"}])
    rows = loading.load_evaluation(spark, path, benchmark="lvbench", split="test").collect()
    assert [(r.sample_id, r.videos, json.loads(r.answer)) for r in rows] == [(s, ROW["videos"], ROW["answer"]) for s in ("s1", "s2")]
    with pytest.raises(ValueError, match="split must be train"):
        loading.load_evaluation(spark, path, split="train")
    path = write(tmp_path / "bad.jsonl", [ROW, ROW, {**ROW, "sample_id": " s3", "videos": ["elsewhere/a.mp4"]}])
    with pytest.raises(ValueError, match="bad.jsonl:2: .*whitespace.*videos must lie.*duplicate_id s1"):
        loading.load_evaluation(spark, path)


def test_samples_are_adapted(spark, tmp_path):
    plain = {"question": "q", "video": "x.mp4", "schema_version": 1}
    media = {**ROW, "images": [{"path": "./b.png", "size": 3}], "choices": ["x"], "id": "own", "subtitles": ["media/s.srt"]}
    path = write(tmp_path / "rows.jsonl", [ROW, plain, media])
    rows = {r.ordinal: (r.canonical, {k: json.loads(v) for k, v in r.fields.items()}) for r in loading.load_samples(spark, path, "/data", "/assets").collect()}
    assert rows[1] == (False, plain)
    told = rows[0][1]
    assert rows[0][0] and told["videos"] == ["/assets/media/video_qa/lvbench/videos/a.mp4"] and told["video"] == told["path"] == told["videos"][0]
    assert (told["id"], told["question"], told["time"], told["year"], told["options"], told["data_type"]) == ("s1", "What?", [1, 2], 7, [], "video")
    assert told["ground_truth"] == ROW["answer"] and "note" not in told and "image" not in told and told["image_list"] == []
    told = rows[2][1]
    assert (told["id"], told["question_id"], told["options"], told["image"], told["subtitle"], told["data_type"]) == ("own", "s1", ["x"], "/data/b.png", "/assets/media/s.srt", "video")
    path = write(tmp_path / "out.jsonl", [{**ROW, "videos": ["../x.mp4"]}])
    with pytest.raises(Exception, match="leaves the evaluation roots"):
        loading.load_samples(spark, path, "/data").collect()
