"""Malformed records of text files go to a table of their own; the others are read as ever."""

import json

import pytest
from builders import as_dicts
from checks import spark_result

from stepfall.plans import profile
from stepfall.sources import SCHEMAS, read_files, read_with_rejects

GOOD = {
    "app_downloads": [{"app_download_key": 1, "platform": "ios", "download_ts": "2021-03-01T10:00:00"}, {"app_download_key": None, "platform": None, "download_ts": None}],
    "signups": [{"user_id": 1, "session_id": 1, "age_range": "18-24"}],
    "ride_requests": [{"ride_id": 1, "user_id": 1, "driver_id": None, **dict.fromkeys(SCHEMAS["ride_requests"].names[3:], "2021-03-01T10:00:00")}],
    "transactions": [{"ride_id": 1, "purchase_amount_usd": 1.5, "charge_status": "Approved"}, {"ride_id": 2, "purchase_amount_usd": -3.0, "charge_status": "x, \"y\""}],
    "reviews": [{"ride_id": 1, "user_id": 1}],
}
#: Of each, the reason.
BAD = {
    "app_downloads": [({"app_download_key": 2, "platform": "web", "download_ts": "soon"}, "download_ts is no timestamp_ntz: soon")],
    "signups": [({"user_id": "abc", "session_id": 1, "age_range": "a"}, "user_id is no bigint: abc"), ({"user_id": "1.5", "session_id": 1, "age_range": "a"}, "user_id is no bigint: 1.5")],
    "transactions": [({"ride_id": 3, "purchase_amount_usd": "much", "charge_status": "Approved"}, "purchase_amount_usd is no double: much")],
}
#: Lines that do not parse at all.
BROKEN = {"csv": {"reviews": ["1,2,3", "7"]}, "json": {"reviews": ['{"ride_id": 1', "no json"]}}


def _quoted(value):
    if value is None:
        return ""
    text = str(value)
    return '"' + text.replace('"', '\\"') + '"' if "," in text or '"' in text else text


def _write(folder, fmt, with_bad):
    for name, schema in SCHEMAS.items():
        rows = GOOD[name] + ([r for r, _ in BAD.get(name, [])] if with_bad else [])
        lines = [",".join(_quoted(r[c]) for c in schema.names) if fmt == "csv" else json.dumps(r) for r in rows]
        lines += BROKEN[fmt].get(name, []) if with_bad else []
        (folder / name).mkdir(parents=True)
        (folder / name / f"part.{fmt}").write_text("\n".join([",".join(schema.names)] * (fmt == "csv") + lines) + "\n")
    return str(folder)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_good_rows_and_rejects_are_all_rows(spark, tmp_path, fmt):
    clean, mixed = _write(tmp_path / "clean", fmt, False), _write(tmp_path / "mixed", fmt, True)
    strict = read_files(spark, clean, fmt)
    tables, rejects = read_with_rejects(spark, mixed, fmt)
    for (name, want), (_, got) in zip(strict.items(), tables.items(), strict=True):
        assert got.schema.simpleString() == want.schema.simpleString(), name
        assert spark_result(got) == spark_result(want), name
    found = as_dicts(rejects)
    want = [(name, reason) for name, rows in BAD.items() for _, reason in rows] + [("reviews", "the line does not parse")] * 2
    assert sorted((r["table_name"], r["reason"]) for r in found) == sorted(want)
    assert {r["record"] for r in found if r["table_name"] == "reviews"} == set(BROKEN[fmt]["reviews"])
    assert all(f"/mixed/{r['table_name']}/part.{fmt}" in r["file"] for r in found)
    with pytest.raises(Exception):
        spark_result(profile.signups_total(read_files(spark, mixed, fmt)))
    assert spark_result(profile.signups_total(tables)) == spark_result(profile.signups_total(strict))


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_clean_files_have_no_rejects(spark, tmp_path, fmt):
    _, rejects = read_with_rejects(spark, _write(tmp_path, fmt, False), fmt)
    assert rejects.collect() == []


def test_missing_columns_and_other_formats(spark, tmp_path):
    folder = _write(tmp_path, "csv", False)
    (tmp_path / "signups" / "part.csv").write_text("user_id,age_range\n1,a\n")
    with pytest.raises(ValueError, match="signups lacks"):
        read_with_rejects(spark, folder, "csv")
    with pytest.raises(ValueError, match="own types"):
        read_with_rejects(spark, folder, "parquet")
