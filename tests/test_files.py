import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import reports as C
from quernstone.operators import slices as I
from quernstone.sources import files as S
from quernstone.sources import headers as H
from quernstone.sources import ranged as G


def write(root, tree):
    for name, content in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_tree_dates_and_root(spark, tmp_path):
    write(tmp_path, {f"outer/inner/{d}/{u}/s1/{i}.dcm": "x" for d in ("2024-01-02", "20240203") for u in (7, 8) for i in range(2)} | {"outer/inner/notes/7/s/1.dcm": "x"})
    root = S.data_root(spark, str(tmp_path))
    assert root.endswith("outer/inner") and S.data_root(spark, str(tmp_path / "nothing")) == str(tmp_path / "nothing")
    files = S.inventory(spark, root)
    got = {r["unit"]: r["dates"] for r in S.folder_dates(files, "outer/inner").collect()}
    assert got == {7: ["2024-01-02", "20240203"], 8: ["2024-01-02", "20240203"]}


def test_run_report_from_files(spark, tmp_path):
    line = lambda e, f1, **more: json.dumps({"epoch": e, "batch_size": 8, "val_metrics": {"macro_f1": f1, "accuracy": f1 / 2}, "val": {"loss": 1 - f1}, **more})
    write(tmp_path, {
        "vit__normal_vs_ome_20pct/metrics.jsonl": line(0, 0.5) + "\n\n" + line(1, 0.75) + "\n" + line(2, 0.75) + "\n", "vit__normal_vs_ome_20pct/checkpoints/last.pt": "x",
        "res__normal_vs_ome_20pct/metrics.jsonl": line(0, 0.9) + "\n", "res__normal_vs_ome_20pct/checkpoints/best.pt": "x",
        "bad__normal_vs_ome_20pct/metrics.jsonl": line(0, 0.99) + "\n{broken\n", "none__normal_vs_ome_20pct/other.txt": "x",
        "empty__normal_vs_ome_20pct/metrics.jsonl": "\n", "plain_1pct/metrics.jsonl": line(0, 0.3, hparams={"label_task": "normal_vs_csoma"}), "odd/metrics.jsonl": line(0, 0.3),
    })
    files = S.inventory(spark, str(tmp_path))
    runs, lines = S.run_folders(files, tmp_path.name), S.run_logs(spark, str(tmp_path))
    got = {r["run"]: r for r in C.run_report(lines, runs, "macro_f1", 9).collect()}
    status = {k.split("_")[0]: (r["status"], r["rank"]) for k, r in got.items() if r["pct"] == 20}
    assert status["vit"] == ("ok", 1) and status["res"][0] == "incomplete" and status["bad"][0] == "metrics_parse_error" and status["none"][0] == "no_metrics" and status["empty"][0] == "empty_metrics"
    best = got["vit__normal_vs_ome_20pct"]
    assert (best["best_epoch"], best["best_metric"], best["accuracy"], best["val_loss"], best["model"], best["task"]) == (1, 0.75, 0.375, 0.25, "vit", "normal_vs_ome")
    assert got["plain_1pct"]["task"] == "normal_vs_csoma" and "odd" not in got and got["bad__normal_vs_ome_20pct"]["best_metric"] is None
    text = S.markdown(C.run_report(lines, runs, "macro_f1", 9).orderBy("task", "pct", "rank"), ["run", "status"], limit=2)
    assert len(text.splitlines()) == 5 and "more rows" in text


def test_report_documents_and_folders(spark, tmp_path):
    write(tmp_path, {"a/seed1/report.json": '{"auroc": 0.5, "n": 3}', "a/seed2/report.json": "{no", "b/report.json": " ", "b/other.txt": "x"})
    got = {r["path"].split("/")[-2]: (r["status"], r["auroc"]) for r in S.report_documents(spark, str(tmp_path), "auroc double, n long").collect()}
    assert got == {"seed1": ("ok", 0.5), "seed2": ("parse_error", None), "b": ("empty", None)}
    assert S.report_folders(S.inventory(spark, str(tmp_path)), "report.json").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", 2), (1, "b", 1), (2, None, 3)], "id long, t string, n int")
    S.write_json_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 1, "t": "ä", "n": 2}, {"id": 1, "t": "b", "n": 1}, {"id": 2, "t": None, "n": 3}]
    with pytest.raises(FileExistsError):
        S.write_json_report(df, str(tmp_path / "r.json"))
    S.write_nested(df, "id", ["n", "t"], str(tmp_path / "nested"))
    back = {r["id"]: [tuple(x) for x in r["items"]] for r in spark.read.schema("id long, items array<struct<n:int,t:string>>").json(str(tmp_path / "nested")).collect()}
    assert back == {1: [(1, "b"), (2, "ä")], 2: [(3, None)]}
    one = S.cached(df, str(tmp_path / "cache"), crop=3, mode="a")
    again = S.cached(df.limit(0), str(tmp_path / "cache"), mode="a", crop=3)
    assert one.count() == again.count() == 3 and len(list((tmp_path / "cache").glob("*.json"))) == 1
    assert S.warm(df.where("id = 1"), df, ["id"], str(tmp_path / "warm"), v=1).count() == 2
    S.recompress(spark, str(next(p for p in (tmp_path / "cache").iterdir() if p.is_dir())), str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 3


def test_npz_round_trip(spark, tmp_path):
    rows = [(i, "left", i % 6, [float(i), 0.5]) for i in range(20)]
    S.write_npz(spark.createDataFrame(rows, S.EMBEDDINGS).repartition(3), str(tmp_path / "npz"), model="m")
    got = S.read_npz(spark, str(tmp_path / "npz"), 2)
    assert sorted(tuple(r) for r in got.collect()) == rows
    np.savez(tmp_path / "npz" / "flat.npz", emb=np.zeros(3), exam_id=[1, 2, 3], side=["l"] * 3, label_code=[1] * 3)
    with pytest.raises(Exception, match="has the shape"):
        S.read_npz(spark, str(tmp_path / "npz")).collect()


def test_xlsx(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>left</t></is></c></row><row/><row><c r="A2"><v>12</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="C3" t="s"><v>1</v></c></row>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>id</t></si><si><r><t>1</t></r><r><t> : 名</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>")
    got = S.read_xlsx(spark, str(tmp_path), {"id": "unit", "left": "l", "notes": "text"}, optional=["notes"])
    assert [tuple(r) for r in got.collect()] == [("12", "1 : 名", ""), (None, "1 : 名", "")]
    with pytest.raises(Exception, match="lacks the columns"):
        S.read_xlsx(spark, str(tmp_path), {"missing": "m"}).collect()


def element(tag, kind, value, explicit=True):
    value += b" " * (len(value) % 2)
    head = struct.pack("<HH", *tag)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    return head + kind + (struct.pack("<HI", 0, len(value)) if kind in H.LONG_TYPES else struct.pack("<H", len(value))) + value


def image_file(pixels, explicit=True, preamble=True, **texts):
    tags = {v: k for k, v in H.FIELDS.items()}
    fields = {"modality": "CT", "instance": "1", "photometric": "MONOCHROME2"} | texts
    body = [(tags[k], element(tags[k], b"LO", v.encode(), explicit)) for k, v in fields.items()]
    body += [(tags[k], element(tags[k], b"US", struct.pack("<H", v), explicit)) for k, v in {"rows": pixels.shape[0], "cols": pixels.shape[1], "bits": 16, "signed": 1, "samples": 1}.items()]
    nested = struct.pack("<HH", 0x0008, 0x1140) + (b"SQ\0\0" if explicit else b"") + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element((0x0008, 0x0060), b"CS", b"XX", explicit) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body.append(((0x0008, 0x1140), nested))
    body.append((H.PIXELS, element(H.PIXELS, b"OW", pixels.astype("<i2").tobytes(), explicit)))
    head = bytes(128) + b"DICM" + element((2, 0x10), b"UI", b"1.2.840.10008.1.2.1" if explicit else b"1.2.840.10008.1.2") if preamble else b""
    return head + b"".join(b for _, b in sorted(body))


def test_headers_and_slices(spark):
    px = np.arange(12).reshape(3, 4)
    texts = {"slope": "2", "intercept": "-5", "pixel_spacing": "0.5\\0.25", "position": "1\\2\\30.5", "orientation": "-1\\0\\0\\0\\1\\0", "patient_name": "A B", "study_uid": "1.2", "slice_thickness": "0.625", "window_width": "0"}
    rows = [("a", image_file(px, **texts)), ("b", image_file(px, explicit=False, slope="0")), ("c", image_file(px, preamble=False, photometric="MONOCHROME1")), ("d", b"no image"), ("e", image_file(px)[:-30]), ("f", b"")]
    files = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "path string, content binary")
    got = {r["path"]: r for r in H.read_slices(files).collect()}
    assert [got[n]["meta_ok"] for n in "abcdef"] == [True, True, True, False, False, False]
    assert got["a"]["pixels"] == (np.fliplr(px) * 2.0 - 5).ravel().tolist() and (got["a"]["z"], got["a"]["spacing_y"], got["a"]["spacing_x"]) == (30.5, 0.5, 0.25)
    assert got["b"]["pixels"] == px.ravel().tolist() and got["b"]["z"] is None and got["c"]["pixels"] == (11 - px).ravel().tolist()
    meta = {r["path"]: r for r in H.series_meta(H.read_headers(files), "pepper").collect()}
    a = meta["a"]
    assert (a["modality"], a["rows"], a["cols"], a["spacing_x"], a["spacing_z"], a["image_orientation"]) == ("CT", 3, 4, 0.25, 0.625, "-1,0,0,0,1,0")
    assert a["patient_id_hash"] is None and a["patient_key_hash"] == a["patient_name_hash"] is not None and meta["d"]["meta_ok"] is False


def test_canonical_orientation():
    img = np.arange(6).reshape(2, 3)
    same = lambda o, sp=(1, 2): I.canonical(img, o, sp)
    assert same([1, 0, 0, 0, -1, 0])[0].tolist() == img[::-1].tolist() and same([1, 0, 0, 0, 0, -1])[0] is img and same(None)[0] is img
    turned, spacing = same([0, -1, 0, 1, 0, 0])
    assert turned.tolist() == img.T[::-1].tolist() and spacing == (2, 1)
    assert same([0.7, 0.7, 0, 0.7, 0.7, 0])[0] is img


def test_largest_component_against_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.45
        width, least = max(1, min(mask.shape[1], round(0.6 * mask.shape[1]))), int(rng.integers(0, 9))
        seen, parts = np.zeros(mask.shape, bool), []
        for y, x in np.argwhere(mask[:, :width]):
            if seen[y, x]:
                continue
            todo, part = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                part.append((a, b))
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < mask.shape[0] and 0 <= d < width and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
            parts.append(part)
        box = lambda p: (int(min(a for a, _ in p)), int(max(a for a, _ in p)), int(min(b for _, b in p)), int(max(b for _, b in p)))
        got = I.largest_component(mask, 0.6, least)
        if parts:
            wide = [p for p in parts if len(p) >= least] or parts
            assert got == box(max(wide, key=len))
        else:
            assert got == (box([tuple(p) for p in np.argwhere(mask)]) if mask.any() else None)


def test_slice_order_block_and_resample(spark):
    rows = [("a/1.2.10.dcm", None, None), ("a/1.2.9.dcm", None, None), ("a/x.dcm", None, 7), ("a/y.dcm", 5.0, 2), ("a/z.dcm", 5.0, 1), ("a/w.dcm", -3.0, None)]
    df = spark.createDataFrame(rows, "path string, z double, instance int")
    order = [r[0] for r in df.orderBy(I.slice_order(F.col("z"), F.col("instance"), F.col("path"))).select("path").collect()]
    assert order == ["a/w.dcm", "a/z.dcm", "a/y.dcm", "a/x.dcm", "a/1.2.9.dcm", "a/1.2.10.dcm"]
    scores = [0.0] * 20 + [0.9] * 8 + [0.1] * 12
    smooth = [np.mean(scores[max(0, j - 5) : j + 6]) for j in range(40)]
    want = max(0, min(40 - 10, int(np.argmax(smooth)) - 5))
    got = spark.createDataFrame([(scores,)], "s array<double>").select(I.block_start(F.col("s"), 10)).first()[0]
    assert got == want
    img = np.arange(12.0).reshape(3, 4)
    assert np.allclose(I.resample(img, (3, 4)), img) and I.resample(img, (1, 1)).tolist() == [[5.5]] and np.allclose(I.resample(img, (6, 4))[:2, 0], [0, 1])
    assert I.to_spacing(img, (1.0, 0.5), 0.5).shape == (6, 4) and I.to_spacing(img, (None, 1.0), 0.5) is img


def test_volumes_of_series(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(12):
        img = np.full((20, 30), -1000.0)
        img[5:15, 4:11], img[5:15, 19:27] = 600 + i, 700 + i
        rows.append((1, f"s/{i}.dcm", img.ravel().tolist(), 20, 30, float(11 - i) if i % 2 else float(11 - i), i, 1.0, 1.0))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series long, path string, pixels array<float>, h int, w int, z double, instance int, spacing_y double, spacing_x double")
    spec = I.VolumeSpec(slices=6, size=16, crop=12, midline_slices=3)
    got = {r["side"]: np.frombuffer(bytes(r["data"]), "<f2").reshape(r["shape"]) for r in I.volumes(df, "series", spec).collect()}
    assert {k: v.shape for k, v in got.items()} == {"left": (6, 16, 16), "right": (6, 16, 16)}
    left, right = got["left"].max(axis=(1, 2)), got["right"].max(axis=(1, 2))
    want = [611 - i for i in I.even_places(12, 6)]  # by z, so the last instance comes first
    assert np.allclose(left, want, atol=1) and np.allclose(right, np.add(want, 100), atol=1)
    both = I.volumes(df, "series", spec, whole_units=True).first()
    assert both["shape"] == [2, 6, 16, 16] and both["side"] == "both"
    blocks = I.volumes(df, "series", I.VolumeSpec(slices=4, size=8, crop=12, block=5, z_spacing=0.5)).collect()
    assert [r["shape"] for r in blocks] == [[4, 8, 8]] * 2


def rewritten(plain, syntax):
    """An explicit little-endian file of ``image_file`` in another way of writing."""
    read, out = G.of_bytes(plain), []
    start = G.opened(read)[1]
    if syntax == G.DEFLATED:
        pack = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = pack.compress(plain[start:]) + pack.flush()
    else:
        at = start
        while (found := G.element(read, at, "<", True)) is not None:
            tag, value, size = found
            if size == G.UNKNOWN:
                at = G.passed(read, value, "<", True)
                continue
            kind, data = plain[at + 4 : at + 6], plain[value : value + size]
            swapped = kind in (b"US", b"OW")
            data = np.frombuffer(data, "<u2").astype(">u2").tobytes() if swapped else data
            out.append(struct.pack(">HH", *tag) + kind + (struct.pack(">HI", 0, size) if kind in H.LONG_TYPES else struct.pack(">H", size)) + data)
            at = value + size
        body = b"".join(out)
    return bytes(128) + b"DICM" + element((2, 0x10), b"UI", syntax.encode()) + body


def run_length_file(px):
    """Pixels of 16 bits as two run-length segments, behind a header in plain writing."""
    def segment(raw):
        out, at = bytearray(), 0
        while at < len(raw):
            n = 1
            while at + n < len(raw) and n < 128 and raw[at + n] == raw[at]:
                n += 1
            out += bytes([257 - n, raw[at]]) if n > 1 else bytes([0, raw[at]])
            at += n
        return bytes(out) + bytes(len(out) % 2)

    raw = px.astype("<i2").tobytes()
    high, low = segment(raw[1::2]), segment(raw[0::2])
    frame = struct.pack("<16I", 2, 64, 64 + len(high), *[0] * 13) + high + low
    item = lambda tag, data: struct.pack("<HHI", *tag, len(data)) + data
    pixels = struct.pack("<HH", *G.PIXELS) + b"OB" + struct.pack("<HI", 0, G.UNKNOWN) + item(G.ITEM, b"") + item(G.ITEM, frame) + item(G.SEQUENCE_END, b"")
    plain = image_file(px)
    read = G.of_bytes(plain)
    at = start = G.opened(read)[1]
    while G.element(read, at, "<", True)[0] != G.PIXELS:
        tag, value, size = G.element(read, at, "<", True)
        at = G.passed(read, value, "<", True) if size == G.UNKNOWN else value + size
    return bytes(128) + b"DICM" + element((2, 0x10), b"UI", G.RUN_LENGTH.encode()) + plain[start:at] + pixels


def test_headers_by_ranged_reads(spark, tmp_path):
    px = np.arange(1 << 19).reshape(512, 1024) % 30000  # a megabyte of pixels
    texts = {"patient_name": "A B", "study_uid": "1.2", "slice_thickness": "0.625", "slope": "2"}
    plain = image_file(px, **texts)
    files = {"p1/s1/a.dcm": plain, "p1/s1/b.DCM": rewritten(plain, G.BIG), "p1/s2/c.dcm": rewritten(plain, G.DEFLATED), "p2/s1/deep/d.dcm": run_length_file(px), "e.dcm": image_file(px, explicit=False, **texts), "p2/f.dcm": b"no image", "p2/g.dcm": b"", "p2/h.dcm": plain[:200], "p2/notes.txt": b"text"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].removeprefix(f"{tmp_path}/"): r for r in G.header_files(spark, str(tmp_path), suffix=".dcm", partitions=3).collect()}
    assert set(got) == set(files) - {"p2/notes.txt"}
    good = ["p1/s1/a.dcm", "p1/s1/b.DCM", "p1/s2/c.dcm", "p2/s1/deep/d.dcm", "e.dcm"]
    assert [n for n in got if got[n]["meta_ok"]] and {n for n in got if got[n]["meta_ok"]} == set(good)
    assert all((got[n]["modality"], got[n]["rows"], got[n]["cols"], got[n]["bits"]) == ("CT", 512, 1024, 16) for n in good)
    assert all(got[n]["slope"] == "2" and got[n]["patient_name"] == "A B" for n in good if "deep" not in n)
    assert max(got[n]["bytes_read"] for n in got) <= 3 * G.STEP < len(plain) / 80
    few = G.header_files(spark, f"file://{tmp_path}", ["modality", "rows"], ".dcm", step=256)
    assert few.columns == ["path", "meta_ok", "modality", "rows", "bytes_read"]
    assert {r["path"].removeprefix(f"{tmp_path}/") for r in few.where("meta_ok AND rows = 512 AND modality = 'CT'").collect()} == set(good)
    with pytest.raises(Exception, match="no fields"):
        G.header_files(spark, str(tmp_path), ["colour"]).collect()
    meta = {r["path"].removeprefix(f"{tmp_path}/"): r for r in H.series_meta(G.header_files(spark, str(tmp_path)).drop("bytes_read"), "pepper").collect()}
    assert meta["p1/s1/b.DCM"]["spacing_z"] == 0.625 and meta["p1/s1/b.DCM"]["patient_name_hash"] == meta["p1/s1/a.dcm"]["patient_name_hash"] is not None


def test_pixels_in_other_ways_of_writing(spark):
    px = np.arange(-30, 30).reshape(6, 10) // 4
    plain = image_file(px, slope="2")
    rows = [("a", plain), ("b", rewritten(plain, G.BIG)), ("c", rewritten(plain, G.DEFLATED)), ("d", run_length_file(px)), ("e", run_length_file(px)[:-40]), ("f", rewritten(plain, G.DEFLATED)[:-20])]
    got = {r["path"]: r for r in H.read_slices(spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "path string, content binary")).collect()}
    assert [got[n]["meta_ok"] for n in "abcdef"] == [True] * 4 + [False] * 2
    assert all(got[n]["pixels"] == (px * 2.0).ravel().tolist() for n in "abc") and got["d"]["pixels"] == px.ravel().tolist()


def test_seed_reports_are_summarised(spark, tmp_path):
    for name, auprc in (("r50_six_20pct_seed1", 0.5), ("r50_six_20pct_seed2", 0.7), ("vit_six_20pct", 0.9)):
        (tmp_path / "x" / name).mkdir(parents=True)
        (tmp_path / "x" / name / "report.json").write_text(json.dumps({"binary": {"auprc": auprc, "f1": None}, "other": [1]}))
    for name, text in (("r50_six_20pct_seed3", "{broken"), ("vit_six_1pct_seed4", "")):
        (tmp_path / "x" / name).mkdir()
        (tmp_path / "x" / name / "report.json").write_text(text)
    report = C.seed_report(spark, str(tmp_path))
    runs = {r["run"]: r for r in report["runs"].collect()}
    assert (runs["r50_six_20pct_seed3"]["status"], runs["r50_six_20pct_seed3"]["auprc"], runs["vit_six_20pct"]["seed"]) == ("parse_error", None, None)
    rows = [(r["backbone"], r["pct"], r["auprc_n"]) for r in report["summary"].collect()]
    assert rows[:2] == [("vit", 20, 1), ("r50", 20, 2)]
    best = report["summary"].where("backbone = 'r50'").first()
    assert abs(best["auprc_mean"] - 0.6) < 1e-12 and abs(best["auprc_std_samp"] - np.std([0.5, 0.7], ddof=1)) < 1e-12 and best["f1_n"] == 0


def plain_lateral(img, share):
    """The score of a slice by loops over its pixels."""
    h, w = img.shape
    band = max(1, min(w // 2, int(round(share * w))))

    def box(low, high):
        spots = [(y, x) for y in range(h) for x in range(low, high) if img[y, x] > I.BONE]
        if not spots:
            return 0.0
        y0, y1, x0, x1 = min(y for y, _ in spots), max(y for y, _ in spots), min(x for _, x in spots), max(x for _, x in spots)
        dy, dx = max(1, int(round((y1 - y0) * 0.05))), max(1, int(round((x1 - x0) * 0.05)))
        inside = [img[y, x] for y in range(max(0, y0 - dy), min(h - 1, y1 + dy) + 1) for x in range(max(low, x0 - dx), min(high - 1, x1 + dx) + 1)]
        return sum(v < I.AIR for v in inside) / len(inside)

    return max(box(0, band), box(w - band, w)) or box(0, w)


def test_lateral_scores_and_blocks_by_probes():
    rng = np.random.default_rng(4)
    for _ in range(60):
        img = rng.choice([-1000.0, 0.0, 500.0], (int(rng.integers(1, 20)), int(rng.integers(2, 24))), p=[0.3, 0.6, 0.1])
        assert abs(I.lateral_air(img, 0.25) - plain_lateral(img, 0.25)) < 1e-12
    images = []
    for i in range(50):
        img = np.zeros((12, 16))
        img[2:10, 1:4] = 500
        if 30 <= i < 38:
            img[4:8, 2] = -900
        images.append(img)
    spec = I.VolumeSpec(slices=5, block=10, lateral=0.25, probes=10)
    at = range(0, 50, 5)
    scores = [plain_lateral(images[i], 0.25) for i in at]
    smooth = [np.mean(scores[max(0, j - 5) : j + 6]) for j in range(len(at))]
    start = max(0, min(40, at[int(np.argmax(smooth))] - 5))
    got = I._stack(images, np.full(50, np.nan), spec)
    assert [next(k for k in range(50) if images[k] is g) for g in got] == [start + k for k in I.even_places(10, 5)]


def test_windows_and_pair_features(spark):
    rng = np.random.default_rng(2)
    images = [rng.normal(0, 900, (20, 30)).astype(np.float32) for _ in range(6)]
    z, gaps = np.arange(6.0), [(None, None)] * 6
    plain = I.VolumeSpec(slices=4, size=8, crop=12)
    raw = I.build_volume(images, z, gaps, plain)
    two = I.build_volume(images, z, gaps, I.VolumeSpec(slices=4, size=8, crop=12, window=(700.0, 4000.0), window2=(40.0, 400.0), pair=True))
    unit = lambda v, c, w: (np.clip(v, c - w / 2, c + w / 2) - (c - w / 2)) / (w + 1e-6)
    for side, other in (("left", "right"), ("right", "left")):
        own, far = (np.stack([unit(raw[s], 700.0, 4000.0), unit(raw[s], 40.0, 400.0)]) for s in (side, other))
        assert two[side].shape == (6, 4, 8, 8) and np.allclose(two[side], np.concatenate([own, far, abs(own - far)]), atol=1e-6)
    assert I.build_volume(images, z, gaps, I.VolumeSpec(slices=4, size=8, crop=12, window=(0.0, 100.0)))["left"].shape == (1, 4, 8, 8)
    with pytest.raises(ValueError, match="window"):
        I.build_volume(images, z, gaps, I.VolumeSpec(slices=4, size=8, crop=12, pair=True))
    rows = [(1, f"s/{i}.dcm", img.ravel().tolist(), 20, 30, float(i), i, 1.0, 1.0) for i, img in enumerate(images)]
    df = spark.createDataFrame(rows, "series long, path string, pixels array<float>, h int, w int, z double, instance int, spacing_y double, spacing_x double")
    assert I.volumes(df, "series", I.VolumeSpec(slices=4, size=8, crop=12, window=(700.0, 4000.0)), whole_units=True).first()["shape"] == [2, 1, 4, 8, 8]


def test_two_writers_of_a_cache_read_one_table(spark, tmp_path):
    import threading

    got, errors = [], []

    def work(k):
        try:
            got.append(sorted(r["id"] for r in S.cached(spark.range(k, k + 5), str(tmp_path), v=1).collect()))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    both = [threading.Thread(target=work, args=(k,)) for k in (0, 100)]
    [t.start() for t in both], [t.join() for t in both]
    assert not errors and got[0] == got[1] and got[0] in ([*range(5)], [*range(100, 105)])
    (folder,) = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert len([p for p in folder.iterdir() if p.name.startswith("run=")]) == 1


def test_npz_files_are_cut_by_rows(spark, tmp_path):
    rows = [(i, "left", i % 6, [float(i), 1.0]) for i in range(25)]
    df = spark.createDataFrame(rows, S.EMBEDDINGS).coalesce(2)
    n = S.write_npz(df, f"file://{tmp_path}/npz", rows=4, model="m")
    assert n == len(list((tmp_path / "npz").glob("*.npz"))) == len(list((tmp_path / "npz").iterdir())) >= 7
    assert sorted(r["unit_id"] for r in S.read_npz(spark, str(tmp_path / "npz"), 2).collect()) == list(range(25))
    with pytest.raises(Exception, match="FileExistsError"):
        S.write_npz(df, str(tmp_path / "npz"), rows=4)
    assert S.write_npz(df.limit(0), str(tmp_path / "none")) == 0


def test_volumes_from_headers_read_only_what_they_hold(spark, tmp_path):
    rng, pixels = np.random.default_rng(8), {}
    for series, n in (("1.2", 23), ("1.3", 4)):
        for i in rng.permutation(n).tolist():
            img = rng.integers(-1000, 900, (18, 26))
            path = tmp_path / "e" / series / f"x.{i}.dcm"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(image_file(img, series_uid=series, position=f"0\\0\\{n - i}.5", instance=str(i), pixel_spacing="1\\1"))
            pixels[str(path)] = (series, img, n - i + 0.5, i)
    (tmp_path / "e" / "1.3" / "broken.dcm").write_bytes(b"nothing")
    spec = I.VolumeSpec(slices=7, size=8, crop=12)
    wanted = H.even_slices(G.header_files(spark, str(tmp_path), suffix=".dcm"), "series_uid", 7)
    assert wanted.groupBy("series_uid").count().orderBy("series_uid").collect() == [("1.2", 7), ("1.3", 4)]
    got = {(r["series_uid"], r["side"]): bytes(r["data"]) for r in H.even_volumes(spark, str(tmp_path), spec).collect()}
    rows = [(s, p, img.ravel().astype(float).tolist(), 18, 26, z, i, 1.0, 1.0) for p, (s, img, z, i) in pixels.items()]
    df = spark.createDataFrame(rows, "series_uid string, path string, pixels array<float>, h int, w int, z double, instance int, spacing_y double, spacing_x double")
    assert got == {(r["series_uid"], r["side"]): bytes(r["data"]) for r in I.volumes(df, "series_uid", spec).collect()} and len(got) == 4
    with pytest.raises(ValueError, match="all slices"):
        H.even_volumes(spark, str(tmp_path), I.VolumeSpec(block=5))
