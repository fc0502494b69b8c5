import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import image, report, svg
from lexiloom.plans import archive, cli
from lexiloom.sources import files as sources
from lexiloom.sources import sinks

CODE = {
    "a.py": "import os\n\n# gone\ndef f(x):\n    return os.path.join(x, 'a', 'a')\n",
    "sub/b.js": "const x = { a: 1 }; // gone\nfunction f(y) {\n  return y + x.a;\n}\n",
    "c.GO": "package main\nfunc main() { fmt.Println(\"it's\") }\n",
    "pic.svg": '<svg><!-- c --><defs> </defs><path d="M 1.25 2.0" fill="none" stroke="#123"/></svg>',
    "notes.txt": "not supported",
    "bad.py": "x = (",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in CODE.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rgb = np.zeros((6, 300, 3), np.uint8)
    rgb[2:4, :, 0], rgb[4, ::2, 1] = 200, 90
    (tmp_path / "p.png").write_bytes(sinks.png(300, 6, rgb.tobytes()))
    return tmp_path


def test_scan(spark, tree):
    (tree / "latin.js").write_bytes(b"x = '\xe9'")
    (tree / "crlf.js").write_bytes(b"a\r\nb\rc")
    rows = {r.rel_path: r for r in sources.scan_directory(spark, str(tree)).collect()}
    assert "notes.txt" not in rows and rows["c.GO"].file_type == "c" and rows["p.png"].text is None and rows["sub/b.js"].fname == "b.js"
    assert rows["latin.js"].error == "not UTF-8" and rows["crlf.js"].text == "a\nb\nc"
    assert [r.rel_path for r in sorted(rows.values(), key=lambda r: r.file_ord)] == sorted(rows, key=lambda p: p.split("/"))
    found, left = sources.scan_files(spark, [str(tree / "a.py"), str(tree / "none.py"), str(tree / "notes.txt")])
    assert [r.fname for r in found.collect()] == ["a.py"] and {r.reason for r in left.collect()} == {"no such file", "unsupported type"}


def test_pack_and_unpack(spark, tree, tmp_path_factory):
    scanned = sources.scan_directory(spark, str(tree))
    images = sources.scan_images(spark, str(tree / "p.png"))
    assert {r.fname for r in archive.rejected(scanned).collect()} == {"bad.py"}
    packed, psnr = archive.pack(scanned, images, clusters=3)
    out = tmp_path_factory.mktemp("packed")
    sinks.write_files(packed.select(F.lit("t.compress").alias("fname"), F.col("blob").alias("content")), str(out))
    assert psnr.first().psnr == float("inf")
    listed = sources.scan_archives(spark, str(out / "t.compress")).orderBy("file_ord").collect()
    assert [(r.fname, r.file_type) for r in listed] == [("a.py", "p"), ("c.GO", "c"), ("b.js", "c"), ("pic.svg", "s"), ("p.png", "g")]
    done = {r.fname: r for r in archive.open_archive(spark, str(out / "t.compress")).collect()}
    assert done["a.py"].text == "import os\ndef f(x):\n    return os.path.join(x, 'a', 'a')\n"
    assert done["b.js"].text == "const x = {a: 1}; \n".replace(" \n", "\n") + "function f(y){\n  return y + x.a;\n}\n"
    assert done["pic.svg"].text == '<svg><path d="M 1.2 2" stroke="#123"/></svg>'
    assert (done["p.png"].width, done["p.png"].height) == (300, 6) and bytes(done["p.png"].content)[:4] == b"\x89PNG"
    back = out / "p.png"
    back.write_bytes(done["p.png"].content)
    assert bytes(sources.scan_images(spark, str(back)).first().pixels) == bytes(images.first().pixels)


def test_command_lines(spark, tree, tmp_path, capsys):
    assert cli.main(["pack", "-d", str(tree), "-o", str(tmp_path / "o"), "-k", "3"]) == 0
    path = tmp_path / "o" / f"{tree.name}.compress"
    assert cli.main(["unpack", str(path), str(tmp_path / "u")]) == 0
    assert sorted(os.listdir(tmp_path / "u" / tree.name)) == ["a.py", "b.js", "c.GO", "p.png", "pic.svg"]
    assert cli.main(["pack", "--info", "-d", str(tree)]) == 0 and "300x6, 3 colors" in capsys.readouterr().out
    assert cli.main(["pack", str(tree / "none.py")]) == 1 and cli.main(["unpack", "nowhere"]) == 1 and cli.main(["pack"]) == 1


def test_container_limits():
    blob = sinks.build_container(b"", [("x.svg", "s", b"abc"), ("d/y.svg", "s", b"")])
    assert sources.parse_container(blob) == (b"", [("x.svg", "s", b"abc"), ("d/y.svg", "s", b"")])
    for name in ("../x.svg", "/x.svg", "a//b", "", "a/./b"):
        with pytest.raises(ValueError, match="unsafe"):
            sinks.build_container(b"", [(name, "s", b"")])
    with pytest.raises(ValueError, match="unknown file type"):
        sinks.build_container(b"", [("x", "?", b"")])
    raw = struct.pack(">I", 0) + struct.pack(">H", 1) + struct.pack(">H", 1) + b"x?" + struct.pack(">I", 0)
    import lzma

    with pytest.raises(ValueError, match="unknown file type"):
        sources.parse_container(lzma.compress(raw))


def test_paths_and_bundles(spark):
    assert sinks.archive_path(["x/a.b.py"]) == "compress/a.b/a.b.compress" and sinks.archive_path([], "d/e/", "o") == "o/e.compress"
    assert sinks.output_directory("p/t.compress", 2) == "output/t" and sinks.output_directory("t.compress", 1, "u") == "u"
    literal = sinks.build_bundle({"a": "1", "b": "é"})
    assert sources.read_bundle(literal) == {"a": "1", "b": "é"} and json.loads(zlib.decompress(__import__("base64").b64decode(literal)))["a"] == "1"
    rows = sources.scan_bundles(spark.createDataFrame([(literal,)], "literal string")).collect()
    assert {r.fname: r.text for r in rows} == {"a": "1", "b": "é"}


@pytest.mark.parametrize("seed,h,w,k", [(1, 7, 9, 3), (2, 1, 1, 1), (3, 4, 700, 2), (4, 300, 3, 5)])
def test_runs_three_ways(spark, seed, h, w, k):
    rng = np.random.default_rng(seed)
    labels = np.repeat(rng.integers(0, k, (h, -(-w // 3))), 3, axis=1)[:, :w] if w < 600 else np.sort(rng.integers(0, k, (h, w)), axis=1)
    if h > 200:
        labels[5:200] = 0
    palette = rng.integers(0, 256, (k, 3)).astype(np.uint8)
    stream = struct.pack("<II", w, h) + image.encode_runs(labels, palette)
    assert image.decode_image(stream) == (w, h, palette[labels].tobytes())
    frame = spark.createDataFrame([("i", y, x, int(labels[y, x])) for y in range(h) for x in range(w)], "img string, y int, x int, ci int")
    colors = spark.createDataFrame([("i", i, *map(int, c)) for i, c in enumerate(palette)], "img string, ci int, r int, g int, b int")
    sizes = spark.createDataFrame([("i", w, h)], "img string, width int, height int")
    runs = image.runs(frame).cache()
    assert image.stream_hex(runs, colors, sizes).first().stream_hex == stream.hex().upper()
    assert sorted(map(tuple, image.expand(runs, sizes).select("img", "y", "x", "ci").collect())) == sorted(map(tuple, frame.collect()))


def test_run_limits():
    with pytest.raises(ValueError, match="255 colours"):
        image.encode_runs(np.zeros((1, 1), int), np.zeros((256, 3)))
    with pytest.raises(ValueError, match="too large"):
        image.encode_runs(np.arange(600).reshape(1, 600) % 2, np.zeros((2, 3)))


def test_quantize(spark):
    points = spark.createDataFrame([(i % 2 * 200, 10, i % 2 * 100) for i in range(100)], "r int, g int, b int")
    labelled, palette = image.quantize(points, ["r", "g", "b"], k=2)
    assert sorted((r.c_r, r.c_g, r.c_b) for r in palette.collect()) == [(0, 10, 0), (200, 10, 100)]
    assert image.quality(labelled, palette, ["r", "g", "b"]).first().psnr == float("inf")


def test_svg_steps(spark):
    drawn = '<g stroke-linecap="round" transform="translate(1 2) rotate(0 10.5 4)"><path d="x" stroke="none" stroke-width="0" fill="#abc"></path><path stroke="#d00" stroke-width="3" fill="none"></path></g>'
    cases = {
        '<?xml version="1.0" standalone="no"?><a x="0.15 -3.04 2.0 0.35"/>': '<?xml version="1.0"?><a x="0.1 -3 2 0.3"/>',
        '<style class="style-fonts">\nx</style><mask> </mask><metadata></metadata><b  c="#ffffff">  </b>': '<b c="#fff"></b>',
        '<t direction="ltr" font-family="Comic Shanns, monospace, Segoe UI Emoji"/>': '<t font-family="monospace"/>',
        drawn: '<g transform="translate(1 2) rotate(0 10.5 4)"><rect x="0" y="0" width="21" height="8" rx="2" ry="2" fill="#abc" stroke="#d00" stroke-width="3"></rect></g>',
        # Next to a stroke fill="none" goes, and with it what tells the stroke.
        drawn.replace('stroke="#d00" stroke-width="3" fill="none"', 'fill="none" stroke="#d00" stroke-width="3"'): '<g transform="translate(1 2) rotate(0 10.5 4)"><rect x="0" y="0" width="21" height="8" rx="2" ry="2" fill="#abc" stroke="#1971c2" stroke-width="2"></rect></g>',
        '<g stroke-linecap="round" transform="x">y</g>': '<g stroke-linecap="round" transform="x">y</g>',
    }
    rows = svg.rewrite(spark.createDataFrame([(s,) for s in cases], "text string")).collect()
    assert [r.text for r in rows] == list(cases.values())


def test_report(spark):
    files = spark.createDataFrame([("p", ".py", 9, "é"), ("g", ".png", 70, None), ("p", ".py", 9, "ab")], "file_type string, ext string, n_bytes long, text string")
    assert report.original_bytes(files).first().orig_bytes == 74
    assert {(r.file_type, r.files, r.exts) for r in report.by_type(files).collect()} == {("p", 2, ".py"), ("g", 1, ".png")}
    assert spark.range(1).select(*report.ratio(F.lit(0), F.lit(5))).first().percent is None
