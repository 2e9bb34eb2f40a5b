"""Mirror files are read by their own headers."""

import gzip

import pytest

from pulseframe import schema as S
from pulseframe.operators.clean import parse_mirror
from pulseframe.sources import mirror_csv

FULL = {c: "" for c in S.MIRROR_COLUMNS} | {
    "user_id": "u", "timestamp": "2024-01-10T10:05:00Z", "metric_type": "heart_rate", "metric_value": "60.5", "unit": "bpm",
    "timezone": "UTC", "op": "upsert", "hk_uuid": "h1", "end_ts": "2024-01-10T10:06:00Z", "hk_source_name": "Watch", "hk_metadata": '"{""a"": 1}"',
}


def write(folder, name, columns, *rows, header=None, opener=open):
    lines = [",".join(header or columns), *(",".join(r.get(c, "x") for c in columns) for r in rows)]
    with opener(folder / name, "wt") as f:
        f.write("\n".join(lines) + "\n")


def typed(spark, path):
    return [r.asDict(recursive=True) for r in parse_mirror(mirror_csv.read_mirror_csv(spark, str(path))).drop("ordinal").collect()]


def test_order_and_surplus_columns_change_nothing(spark, tmp_path):
    write(tmp_path, "full.csv", S.MIRROR_COLUMNS, FULL)
    want = typed(spark, tmp_path / "full.csv")
    assert want[0]["metric_value"] == 60.5 and want[0]["hk_metadata"] == '{"a": 1}'
    write(tmp_path, "reversed.csv", S.MIRROR_COLUMNS[::-1], FULL)
    write(tmp_path, "wider.csv", ["firmware", *S.MIRROR_COLUMNS, "battery"], FULL)
    write(tmp_path, "spaced.csv", S.MIRROR_COLUMNS, FULL, header=["﻿user_id", *(f" {c}" for c in S.MIRROR_COLUMNS[1:])])
    write(tmp_path, "twice.csv", [*S.MIRROR_COLUMNS, "extra"], FULL, header=[*S.MIRROR_COLUMNS, "unit"])
    write(tmp_path, "packed.csv.gz", S.MIRROR_COLUMNS, FULL, opener=gzip.open)
    for name in ("reversed.csv", "wider.csv", "spaced.csv", "twice.csv", "packed.csv.gz"):
        assert typed(spark, tmp_path / name) == want, name
    assert typed(spark, tmp_path) == want * 6


@pytest.mark.parametrize("gone", ["unit", "op", "end_ts", "timezone", "user_id", "hk_metadata"])
def test_a_missing_column_shifts_nothing(spark, tmp_path, gone):
    write(tmp_path, "old.csv", [c for c in S.MIRROR_COLUMNS if c != gone], FULL)
    write(tmp_path, "full.csv", S.MIRROR_COLUMNS, FULL)
    old, full = typed(spark, tmp_path / "old.csv")[0], typed(spark, tmp_path / "full.csv")[0]
    changed = {c for c in full if old[c] != full[c]}
    assert changed == {"op": set(), "timezone": {"meta"}}.get(gone, {gone}) and old["op"] == "upsert"


def test_rows_wider_than_their_header_keep_their_place(spark, tmp_path):
    with open(tmp_path / "deltas.csv", "w") as f:
        f.write(",".join(S.MIRROR_COLUMNS) + "\n" + ",".join(FULL.values()) + "\n")
        f.write("u,,,,,,,,,,,,delete,h9,,,,,,,\n")
    rows = mirror_csv.read_mirror_csv(spark, str(tmp_path)).collect()
    assert [(r.op, r.hk_uuid, r._corrupt_record is not None) for r in rows] == [("upsert", "h1", False), ("delete", "h9", True)]


def test_cells_over_lines(spark, tmp_path, monkeypatch):
    row = FULL | {"hk_source_name": '"My\nold ""Watch"""'}
    write(tmp_path, "lines.csv", S.MIRROR_COLUMNS, row, FULL | {"hk_uuid": "h2"})
    for limit in (S.MAX_UPLOAD_BYTES, 10):  # whole files, and files that are looked through first
        monkeypatch.setattr(S, "MAX_UPLOAD_BYTES", limit)
        got = typed(spark, tmp_path)
        assert [(r["hk_uuid"], r["hk_source_name"]) for r in got] == [("h1", 'My\nold "Watch"'), ("h2", "Watch")]


def test_missing_required_column_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    write(tmp_path, "header.csv", S.MIRROR_COLUMNS)
    assert typed(spark, tmp_path) == []
    write(tmp_path, "bad.csv", [c for c in S.MIRROR_COLUMNS if c != "metric_value"], FULL)
    with pytest.raises(mirror_csv.HeaderError, match="metric_value.*bad.csv"):
        mirror_csv.read_mirror_csv(spark, str(tmp_path))


def test_rows_keep_their_order_over_files(spark, tmp_path):
    for i, columns in enumerate([S.MIRROR_COLUMNS, S.MIRROR_COLUMNS[::-1]]):
        write(tmp_path, f"f{i}.csv", columns, *(FULL | {"hk_uuid": f"{i}-{k}"} for k in range(3)))
    rows = mirror_csv.read_mirror_csv(spark, str(tmp_path)).orderBy("ordinal").collect()
    own = [[r.hk_uuid for r in rows if r.hk_uuid.startswith(f"{i}-")] for i in range(2)]
    assert own == [[f"{i}-{k}" for k in range(3)] for i in range(2)]
