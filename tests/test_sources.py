"""Readers and writers on small files made here."""

import json
import math
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tracelake.functions import timefn
from tracelake.sinks import files
from tracelake.sources import device, frames, observations, solver

HEAD = "% program   : solver\n% pos mode  : kinematic\n% program   : again\n%  {clock}              {label} longitude(deg)  height(m)   Q  ns\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def pos(path, rows, clock="GPST", label="latitude(deg)"):
    return write(path, HEAD.format(clock=clock, label=label) + "".join(r + "\n" for r in rows))


def test_positions_in_both_clocks(spark, tmp_path):
    rows = ["2024/01/01 00:00:20.500 32.1 34.8 50.0 1 9 0.1 0.2 0.3 0 0 0 1.0 3.5", "2024/01/01 00:00:18.250 32.0 34.8 50.0 2 8"]
    bad = ["2024/01/01 00:00:21.000 32.1 34.8", "2024/01/01 00:00:22.000 32.1 x 50.0 1 9", "junk"]
    a, b = pos(tmp_path / "a.pos", rows + bad), pos(tmp_path / "b.pos", rows, "UTC")
    got = {(r.session_id[-5:], round(r.utc_s, 3)): r for r in solver.read_pos(spark, str(tmp_path / "*.pos")).collect()}
    assert set(got) == {("a.pos", 1704067202.5), ("a.pos", 1704067200.25), ("b.pos", 1704067220.5), ("b.pos", 1704067218.25)}
    first, second = got["a.pos", 1704067202.5], got["a.pos", 1704067200.25]
    assert (first.sd_n, first.sd_u, first.ratio, first.vn) == (0.1, 0.3, 3.5, None)
    assert (second.sd_n, second.quality, second.ns) == (None, 2, 8)
    assert {r.file[-5:]: (r.good, r.bad) for r in solver.pos_bad_records(spark, str(tmp_path / "*.pos")).collect()} == {"a.pos": (2, 3), "b.pos": (2, 0)}
    heads = {r.file[-5:]: r for r in solver.pos_headers(spark, str(tmp_path / "*.pos")).collect()}
    assert (heads["a.pos"].format, heads["a.pos"].time_system, heads["b.pos"].time_system) == ("llh", "GPST", "UTC")
    assert {r.key: r.value for r in solver.pos_config(spark, a).collect()}["program"] == "solver"
    assert b


def test_positions_in_other_axes(spark, tmp_path):
    pos(tmp_path / "x.pos", ["2024/01/01 00:00:18 4430000.0 3080000.0 3380000.0 1 9"], label="x-ecef(m)")
    r = solver.read_pos(spark, str(tmp_path / "x.pos")).first()
    assert 32 < r.lat_deg < 33 and 34 < r.lon_deg < 35
    pos(tmp_path / "e.pos", ["2024/01/01 00:00:18 1 2 3 1 9"], label="e-baseline(m)")
    with pytest.raises(Exception, match="baseline"):
        solver.read_pos(spark, str(tmp_path / "e.pos")).collect()


def test_empty_and_broken_files(spark, tmp_path):
    path = write(tmp_path / "empty.pos", "")
    assert solver.read_pos(spark, path).count() == 0
    assert solver.read_pos(spark, write(tmp_path / "bad.pos", "a b\nc\n")).count() == 0


def test_residuals(spark, tmp_path):
    text = "$SAT,2295,86418.0,G01,1,120.5,45.0,-0.25,0.001,1,180,2,0\n$SAT,2295,x,G02,1,1,1,1,1,1,1,1\n$POS,1,2\n$SAT,2295,86418.0,G03,1,10,5.0,0.0,0.001,0,100,2,0\n$SAT,1,2\n"
    path = write(tmp_path / "s.stat", text)
    rows = solver.read_stat(spark, path)
    r = rows.where("prn = 'G01'").first()
    assert (r.snr, r.az, r.valid, r.fix) == (45.0, 120.5, 1, 2) and r.utc_s == timefn.GPS_EPOCH + 2295 * 604800 + 86418 - 18
    assert rows.count() == 2 and solver.stat_bad_records(spark, path).first().bad == 2
    assert solver.filter_stat(rows, 10.0, True, True).count() == 1


def test_device_records(spark, tmp_path):
    raw = "# Raw,TimeNanos,FullBiasNanos,BiasNanos,HardwareClockDiscontinuityCount,ChipsetElapsedRealtimeNanos\n"
    raw += "Raw,1000000000,-1388102381000000000,0.5,3,5000000000\nRaw,1000000000,-1388102381000000001,0.5,3,5000000001\nRaw,2000000000,-1388102381000000000,0.5,4,0\n"
    fix = "Fix,GPS,32.0,34.8,50,1.5,3.0,90,1704067200000,,,4000000000,6\nFix,fused,32.0,,50,,,,1704067201000,,,1,\nFix,gps,32.1,34.9,,,,,1704067202000,,,6000000000,\nFix,net,32.1,34.9,,,,,1704067203000,,,7000000000,\nFix,short\n"
    orient = "OrientationDeg,1704067200000,1,370.5,1.0,2.0,3\nOrientationDeg,bad\n"
    path = write(tmp_path / "log.txt", raw + fix + orient)
    got = device.read_fixes(spark, path).orderBy("utc_s").collect()
    assert [(r.provider, r.h_acc_m) for r in got] == [("gps", 3.0), ("gps", None), ("net", None)]
    assert device.read_orientation(spark, path).first().yaw_deg == 10.5
    pairs = device.read_clock_pairs(spark, path).orderBy("x_ns").collect()
    assert len(pairs) == 2 and abs(pairs[0].y_s - (timefn.GPS_EPOCH + 1388102382 - 18)) < 1e-6
    bias = device.read_clock_bias(spark, path).orderBy("time_ns").collect()
    assert [(r.time_ns, r.counter) for r in bias] == [(10**9, 3), (2 * 10**9, 4)]
    assert sorted(r.x_ns for r in device.read_fix_pairs(spark, path).collect()) == [4 * 10**9, 6 * 10**9]


def test_inertial_layouts_and_anchors(spark, tmp_path):
    seven = write(tmp_path / "seven.csv", "# head\n1388102418,1,2,3,4,5,6\nbad,1,2,3,4,5,6\n")
    ten = write(tmp_path / "ten.csv", "1388102418,1,2,3,0,0,0,4,5,6\n")
    for path in (seven, ten):
        r = device.read_imu(spark, path).collect()
        assert [(x.gx, x.gz, x.ax, x.az, x.utc_s) for x in r] == [(1, 3, 4, 6, 1388102418 - 16)]
    a = device.read_anchors(spark, write(tmp_path / "a.csv", "x,utc\n# c\n1000,2024-01-01T00:00:00.5Z\n\n2000,1704067201.25,extra\n")).orderBy("x_ns").collect()
    assert [(r.x_ns, r.y_s) for r in a] == [(1000, 1704067200.5), (2000, 1704067201.25)]
    f = device.read_frame_anchors(spark, write(tmp_path / "f.csv", "frame,a,b\n0,5,7\n1,9\n")).orderBy("frame").collect()
    assert [(r.frame, r.boot_ns) for r in f] == [(0, 7), (1, 9)]


def test_manifests_and_calibrations(spark, tmp_path):
    m = device.read_manifest(spark, write(tmp_path / "m.json", json.dumps({"anchor_format": "new", "video_t0_boottime_ns": 12, "names": ["a"]}))).first()
    assert (m.anchor_format, m.video_t0_boottime_ns, m.audio_t0_boottime_ns) == ("new", 12, None)
    (tmp_path / "cal").mkdir()
    for k, (label, date) in enumerate([("Phone", "2024-01-01"), ("phone ", "2024-06-01"), ("other", "2025-01-01")]):
        write(tmp_path / "cal" / f"{k}.json", json.dumps({"device_label": label, "date": date, "sample_rate_hz": 100.0}))
    assert device.find_calibration(device.read_calibrations(spark, str(tmp_path / "cal")), "PHONE").first().date == "2024-06-01"


def obs_file(path):
    def head(body, label):
        return f"{body:<60}{label}\n"

    text = head("  4430000.0000  3080000.0000  3380000.0000", "APPROX POSITION XYZ") + head("G    3 C1C L1C S1C", "SYS / # / OBS TYPES") + head("E    2 C1X", "SYS / # / OBS TYPES") + head("       S1X", "SYS / # / OBS TYPES") + head("", "END OF HEADER")
    for k in range(3):
        text += f"> 2024 01 01 00 00 {k:02d}.5000000  0  2\n"
        text += "G01" + f"{20000000.0 + k:14.3f}  " + f"{100.0 * (k > 0):14.3f}  " + f"{45.0:14.3f}  \n"
        text += "E05" + f"{21000000.0:14.3f}  " + f"{35.0:14.3f}  \n"
    text += "> 2024 01 01 00 00 09.0000000  4  1\nsome event\n"
    return write(path, text)


def test_observations(spark, tmp_path):
    path = obs_file(tmp_path / "o.obs")
    assert {r.system: r.codes for r in observations.signal_codes(spark, path).collect()} == {"G": ["C1C", "L1C", "S1C"], "E": ["C1X", "S1X"]}
    p = observations.phase_check(spark, path).first()
    assert (p.slots, p.nonzero, p.has_phase) == (3, 2, True)
    s = observations.summary(spark, path).first()
    assert (s.epochs, s.mean_sats, s.mean_snr, s.interval_s) == (3, 2.0, 40.0, 1.0)
    assert {r.system: r.snr for r in observations.snr_by_system(spark, path).collect()} == {"G": 45.0, "E": 35.0}
    assert observations.approximate_position(spark, path).first().x == 4430000.0


def test_frame_tables(spark, tmp_path):
    a = write(tmp_path / "g.csv", "# note\nImage,Latitude,Longitude,Altitude,Yaw\na.jpg,32.0,34.8,50,1\na.jpg,33.0,34.8,,2\n")
    rows = frames.read_georef(spark, a).collect()
    assert [(r.stem, r.lat_deg, r.h_m, r.yaw_deg, r.pitch_deg) for r in rows] in ([("a", 33.0, None, 2.0, None)], [])
    t = frames.read_frame_times(spark, write(tmp_path / "t.csv", "Image;t_video_s\nx/a.jpg;0.5\nb.jpg;bad\n")).collect()
    assert [(r.stem, r.t_video_s) for r in t] == [("a", 0.5)]
    text = "label\teasting\tnorthing\taltitude\tzone\np1.png\t669850.0\t3548000.0\t10\t36N\n"
    p = frames.read_external_coordinates(spark, write(tmp_path / "e.tsv", text)).first()
    assert abs(p.lat_deg - 32.05) < 0.1 and abs(p.lon_deg - 34.8) < 0.1
    q = frames.read_external_coordinates(spark, write(tmp_path / "x.csv", "name,x,y,z,lat,lon\np.png,4430000,3080000,3380000,1,2\n")).first()
    assert 32 < q.lat_deg < 33
    s = frames.read_scores(spark, write(tmp_path / "s.csv", "gpstime,lat,lon\n1.0,2.0,3.0\nx,2,3\n")).collect()
    assert [tuple(r) for r in s] == [(1.0, 2.0, 3.0)]
    assert [tuple(r) for r in frames.duplicate_stems(spark.createDataFrame([("a",), ("a",), ("b",)], "stem string")).collect()] == [("a", 2)]


def test_poses(spark, tmp_path):
    text = "# head\n1 1 0 0 0 1.0 2.0 3.0 1 dir/im1.jpg\n0 0 1\n2 0.7071067811865476 0 0 0.7071067811865476 1.0 0.0 0.0 1 im2.jpg\n\n"
    got = {r.stem: r for r in frames.read_poses_text(spark, write(tmp_path / "images.txt", text)).collect()}
    assert (got["im1"].cx, got["im1"].cy, got["im1"].cz) == (-1, -2, -3)
    assert abs(got["im2"].cy - 1.0) < 1e-9
    raw = struct.pack("<Q", 1) + struct.pack("<i7di", 1, 1, 0, 0, 0, 1, 2, 3, 1) + b"im1.jpg\x00" + struct.pack("<Q", 1) + b"\x00" * 24
    (tmp_path / "images.bin").write_bytes(raw)
    r = frames.read_poses_binary(spark, str(tmp_path / "images.bin")).first()
    assert (r.stem, r.cx) == ("im1", -1)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav(spark, tmp_path, width):
    path = tmp_path / f"{width}.wav"
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(8000)
        values = [0, 64, -64]
        w.writeframes(b"".join(((v + 128) if width == 1 else v << (8 * (width - 1))).to_bytes(width, "little", signed=width > 1) * 2 for v in values))
    r = frames.read_wav(spark, str(path)).first()
    assert r.rate == 8000 and r.samples == [0.0, 0.5, -0.5]


def track(spark):
    rows = [("s", 1704067200.0 + k, 32.0 + k * 1e-5, 34.8, 50.0, 1 if k < 3 else 2, 9, 0.1, None, 0.3) for k in range(6)]
    return spark.createDataFrame(rows, "session_id string, utc_s double, lat_deg double, lon_deg double, h_m double, quality int, ns int, sd_n double, sd_e double, sd_u double")


def test_positions_come_back_as_written(spark, tmp_path):
    files.write_pos(track(spark), str(tmp_path / "out"))
    back = solver.read_pos(spark, str(tmp_path / "out" / "session_id=s")).orderBy("utc_s").collect()
    assert [r.utc_s for r in back] == [1704067200.0 + k for k in range(6)]
    assert abs(back[2].lat_deg - 32.00002) < 1e-9 and back[0].sd_e == 0.0


def test_csv_and_map_lines(spark, tmp_path):
    files.write_csv(track(spark), str(tmp_path / "csv"), ["utc_s", "sd_e"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["utc_s", "sd_e"] and back.where("sd_e IS NULL").count() == 6
    from tracelake.operators.islands import colored_segments

    lines = files.coordinates(colored_segments(track(spark)), ["session_id", "run_id", "quality"])
    assert sorted(r.points for r in lines.collect()) == [3, 4]
    marks = files.placemarks(lines, F.lit("run"), F.concat(F.lit("q"), F.col("quality")))
    files.write_kml(marks, str(tmp_path / "kml"))
    doc = "\n".join(r.value for r in spark.read.text(str(tmp_path / "kml")).collect())
    assert doc.count("<Placemark>") == 2 and "#q2" in doc


def test_chosen_columns(spark):
    out = files.export_columns(track(spark), ("llh",), ("utc", "relative"))
    assert out.columns == ["session_id", "utc_s", "t_s", "lat_deg", "lon_deg", "h_m", "quality"]
    with pytest.raises(ValueError, match="there are"):
        files.export_columns(track(spark), ("nowhere",))
    assert math.isclose(out.agg(F.max("t_s")).first()[0], 5.0)


def test_session_folders(spark):
    from tracelake.sources import sessions

    core = ["measurements_1.txt", "recording_1.txt", "sensors_1.txt"]
    listing = {
        "old": core + ["recording_1.mp4", "notes.doc"],
        "new": core + ["recording_1.video_anchor.txt", "capture_meta.json", "audio_1.wav", "audio_anchor_1.txt", "z.mp4"],
        "cut": core + ["recording_1.mp4"],
        "cut/chop_7": ["chop_7.chop_meta.json", "chop_7.mp4", "chop_7.video_anchor.txt"],
        "many": core + ["sensors_2.txt"],
        "half": ["measurements_1.txt"],
    }
    files = spark.createDataFrame([(f"file:/d/{d}/{n}",) for d, names in listing.items() for n in names], "file string")
    got = {r.session.rsplit("/", 1)[1]: r for r in sessions.resolve(files).collect()}
    assert set(got) == {"old", "new", "cut", "many", "half"}
    assert got["old"].format == "old" and got["old"].video.endswith("recording_1.mp4") and got["old"].problem is None
    assert got["new"].format == "new" and got["new"].recording.endswith("/recording_1.txt") and got["new"].video.endswith("z.mp4") and got["new"].audio is not None
    assert got["cut"].clip.endswith("chop_7") and got["cut"].video.endswith("chop_7.mp4") and got["cut"].video_anchor.endswith("chop_7.video_anchor.txt")
    assert got["many"].problem == "several sensors files" and got["half"].problem == "no recording file; no sensors file"


def test_listing_reads_no_contents(spark, tmp_path):
    from tracelake.sources import sessions

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "sensors_1.txt").write_text("x")
    assert [r.file.rsplit("/", 2)[1:] for r in sessions.list_files(spark, str(tmp_path)).collect()] == [["s", "sensors_1.txt"]]


def test_video_probes(spark, tmp_path):
    video = {"codec_type": "video", "width": 1920, "height": "1080", "avg_frame_rate": "30000/1001", "duration": "9.5", "tags": {"Lens": "wide", "Focal_Length": "4.2"}}
    (tmp_path / "a.json").write_text(json.dumps({"streams": [{"codec_type": "audio"}, video], "format": {"size": "1000", "tags": {"lens": "7"}}}))
    (tmp_path / "b.json").write_text(json.dumps({"streams": [], "format": {"duration": "3", "tags": {"lens": "7"}}}))
    (tmp_path / "c.json").write_text("{")
    rows = {r.file[-6]: r for r in device.read_probe(spark, str(tmp_path)).collect()}
    assert (rows["a"].width, rows["a"].height, rows["a"].duration_s, rows["a"].size_bytes, rows["a"].focal_length) == (1920, 1080, 9.5, 1000, 4.2)
    assert abs(rows["a"].fps - 29.97) < 0.01
    assert rows["b"].width is None and rows["b"].duration_s == 3 and rows["b"].focal_length == 7
    assert rows["c"].width is None and rows["c"].focal_length is None
