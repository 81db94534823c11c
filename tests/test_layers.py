"""Layers of maps, and clocks from the best source."""

import glob

import pytest
from pyspark.sql import functions as F

from tracelake.operators import clocks, smoothers
from tracelake.operators.motion import with_enu
from tracelake.sinks import files

PLACES = "session_id long, utc_s double, lat_deg double, lon_deg double, h_m double"


def _path(spark, n, session=1):
    return spark.createDataFrame([(session, float(i), 32.0 + i / 1e5, 34.0 + i / 1e5, None if i == 2 else 5.0) for i in range(n)], PLACES)


@pytest.mark.parametrize(("n", "most", "sizes"), [(10, 4, [5, 5, 2]), (9, 4, [5, 5]), (5, 4, [5]), (4, 4, [4]), (2, 1, [2]), (1, 4, []), (0, 4, [])])
def test_lines_in_parts_meet(spark, n, most, sizes):
    marks = files.layer_marks(files.layers({"a": _path(spark, n)}), most).orderBy("part").collect()
    lines = [m.value.split("<coordinates>")[1].split("</coordinates>")[0].split(" ") for m in marks]
    assert [len(x) for x in lines] == sizes
    assert all(a[-1] == b[0] for a, b in zip(lines, lines[1:]))
    assert len({p for x in lines for p in x}) == (n if n > 1 else 0)


def test_layers_are_documents_and_missing_ones_are_reported(spark, tmp_path):
    many = _path(spark, 12).unionByName(_path(spark, 3, 2)).unionByName(spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (1, 50.0, None, 1.0, 1.0)], PLACES))
    tracks = {"solved": many, "device": _path(spark, 1)}
    report = {(r.session_id, r.layer): (r.points, r.skipped) for r in files.layer_report(tracks, many).collect()}
    assert report == {(1, "solved"): (12, None), (2, "solved"): (3, None), (1, "device"): (1, "one row"), (2, "device"): (0, "no rows")}
    files.write_kml(files.layer_marks(files.layers(tracks), 5), str(tmp_path / "kml"), by="file", order="part")
    folders = sorted(p.rsplit("=", 1)[1] for p in glob.glob(str(tmp_path / "kml" / "file=*")))
    assert folders == ["1_solved", "2_solved"]
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "kml" / "file=1_solved")).collect())
    assert text.startswith("<?xml") and text.rstrip().endswith("</kml>") and text.count("<Placemark>") == 3
    with pytest.raises(ValueError):
        files.layers({})


def test_smoothers_give_layers(spark):
    enu = with_enu(_path(spark, 30).withColumn("h_m", F.lit(5.0)).withColumns({c: F.lit(1.0) for c in ("ve", "vn", "vu")}))
    got = smoothers.tracks(enu, ["raw", "gaussian_car"])
    assert list(got) == ["raw", "gaussian_car"]
    for r in got["raw"].collect():
        assert abs(r.lat_deg - 32.0 - r.utc_s / 1e5) < 1e-10 and abs(r.h_m - 5) < 1e-6
    assert got["gaussian_car"].where("abs(lat_deg - 32.0 - utc_s / 1e5) < 5e-5").count() == 30
    with pytest.raises(KeyError):
        smoothers.tracks(enu, ["none"])


def test_clocks_take_the_best_source(spark):
    line = lambda s, off, n: [(s, k * 10**9, 100.0 + off + k) for k in range(n)]
    kind = "session_id long, x_ns long, y_s double"
    frames = [spark.createDataFrame(rows, kind) for rows in (line(1, 0, 5) + line(2, 0, 1) + [(3, 7, 1.0), (3, 7, 2.0)], line(2, 1, 4) + line(1, 1, 9) + [(4, None, 1.0), (4, 1, 1.0)], line(3, 2, 3) + line(4, 2, 1))]
    got = {r.session_id: (r.source, r.n, round(r.slope * 1e9, 9)) for r in clocks.fit_with_fallback(dict(zip(("recording", "raw", "fixes"), frames))).collect()}
    assert got == {1: ("recording", 5, 1.0), 2: ("raw", 4, 1.0), 3: ("fixes", 3, 1.0)}
    assert clocks.fit_with_fallback({"a": frames[0].limit(0)}).count() == 0


def test_times_in_a_video_are_corrected(spark):
    times = spark.createDataFrame([(1, 10.0, "a"), (2, 1.0, "b")], "session_id long, rel_s double, name string")
    fits = spark.createDataFrame([(1, 1.00001e-9, 0.0, 1704067200.0, 0.1, 10, 1e20)], "session_id long, slope double, xmean double, ymean double, rmse_s double, n long, sxx double")
    starts = spark.createDataFrame([(1, 1483228785.0)], "session_id long, start_utc_s double")
    got = {r.name: r for r in clocks.corrected_times(times, fits, starts, 0.5).collect()}
    a = got["a"]
    assert abs(a.anchored_utc_s - 1704067210.500105) < 1e-6 and abs(a.naive_utc_s - 1483228795.5) < 1e-6 and a.leap_s == 18
    assert abs(a.naive_gpst_s - a.naive_utc_s - 17) < 1e-6 and abs(a.anchored_gpst_s - a.anchored_utc_s - 18) < 1e-6 and a.sigma_s > 0
    b = got["b"]
    assert b.video_s == 1.5 and b.anchored_utc_s is None and b.naive_utc_s is None
