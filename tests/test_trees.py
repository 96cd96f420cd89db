"""Path climbing and shell folders against sequential models."""

import struct

from caseloom.plans import references
from caseloom.sources import records, tiles


def model(entries):
    """entry -> path; a chain that does not end at the root is an orphan from its first missing parent on."""
    def climb(entry):
        names, seen = [], set()
        while True:
            if entry == 5:
                return "", names
            if entry in seen:
                return None, names
            if entry not in entries:
                return "\\$Orphan", names
            seen.add(entry)
            name, parent = entries[entry]
            names.insert(0, name)
            if parent == entry:
                return "\\$Orphan", names
            entry = parent

    out = {}
    for entry, (name, parent) in entries.items():
        base, names = climb(parent)
        if base is None:
            out[entry] = f"\\$Orphan\\{name}"
        else:
            out[entry] = base + "".join(f"\\{n}" for n in names if n) + f"\\{name}"
    return out


def test_paths(spark):
    entries = {i: (f"d{i}", i - 1 if i > 100 else 5) for i in range(100, 330)}
    entries |= {500: ("lost", 9999), 501: ("child", 500), 600: ("x", 601), 601: ("y", 600), 602: ("under", 601), 700: ("self", 700), 701: ("in self", 700)}
    rows = [("h", e, n, p) for e, (n, p) in entries.items()] + [("h", 5, ".", 5)]
    df = spark.createDataFrame(rows, "host_id string, entry long, file_name string, parent_entry long")
    got = {r["entry"]: r["path"] for r in records.with_paths(df, ["host_id"]).collect()}
    assert got.pop(5) == "\\"
    assert got == model(entries)
    assert got[329].count("\\") == 230


def test_deep_paths(spark):
    """2,000 folders in each other, a long cycle, and chains that lead into it: depth has no limit, cycles are orphans."""
    entries = {i: (f"d{i}", i - 1 if i > 100 else 5) for i in range(100, 2100)}
    entries |= {i: (f"c{i}", i + 1 if i < 3699 else 3000) for i in range(3000, 3700)} | {i: (f"t{i}", i - 1 if i > 4000 else 3100) for i in range(4000, 4600)}
    rows = [("h", e, n, p) for e, (n, p) in entries.items()] + [("h", 5, ".", 5)]
    df = spark.createDataFrame(rows, "host_id string, entry long, file_name string, parent_entry long")
    got = {r["entry"]: r["path"] for r in records.with_paths(df, ["host_id"]).collect()}
    assert got.pop(5) == "\\"
    assert got == model(entries)
    assert got[2099].count("\\") == 2000


def wide(text):
    return text.encode("utf-16-le")


def folder_item(name, version=9):
    offset = {9: 46, 8: 42, 7: 34}[version]
    block = struct.pack("<HH", 0, version) + bytes.fromhex("0400efbe")
    block = block.ljust(offset, b"\x01") + wide(name) + b"\0\0"
    return b"\x00\x00\x31" + b"\x00" * 11 + b"SHORT\0\0" + block


def test_shell_items():
    assert references.shell_item(folder_item("Users", 9)) == ("folder", "Users")
    assert references.shell_item(folder_item("바탕", 8)) == ("folder", "바탕")
    assert references.shell_item(folder_item("Old", 7)) == ("folder", "Old")
    assert references.shell_item(b"\x19\x00\x2fC:\\\0\0") == ("volume", "C:")
    assert references.shell_item(b"\x14\x00\x1f\x50abc") == ("root", None)
    assert references.shell_item(b"\x00\x00\x61abc") == ("unknown", None)
    assert references.shell_item(b"\x01") == ("unknown", None)


def test_shellbag_folders(spark):
    base = "\\S-1\\Shell\\BagMRU"
    rows = [(base, "0", b"\x14\x00\x1f\x50abc"), (base + "\\0", "1", b"\x19\x00\x2fC:\\\0\0"), (base + "\\0\\1", "0", folder_item("Users")),
            (base + "\\0\\1\\0", "3", folder_item("Admin")), (base + "\\0\\1\\0", "MRUListEx", b"\x00")]
    data = [("h", "Admin_UsrClass.dat", k, n, raw.hex(), i) for i, (k, n, raw) in enumerate(rows)]
    df = spark.createDataFrame(data, "host_id string, hive string, key_path string, value_name string, value_data string, _rowid long")
    got = sorted((r["path"], r["display"], r["account"]) for r in references.shellbag_folders(df).collect())
    assert got == [("\\users", "C:\\Users", "Admin"), ("\\users\\admin", "C:\\Users\\Admin", "Admin")]


def test_fragments_from_a_small_grid(spark):
    # 1-2 over 3, tile 4 alone with the same look as tile 5.
    rows = [("h", "f", 1, 64, 64, "l1", "e12", None, "d13", "p1"), ("h", "f", 2, 64, 64, "e12", None, None, None, "p2"),
            ("h", "f", 3, 64, 64, None, None, "d13", None, "p3"), ("h", "f", 4, 64, 64, None, None, None, None, "q"), ("h", "f", 5, 64, 64, None, None, None, None, "q")]
    df = spark.createDataFrame(rows, "host_id string, source_file string, tile long, w int, h int, left_edge string, right_edge string, top_edge string, bottom_edge string, rgb string")
    keys = ["host_id", "source_file"]
    placed = tiles.components(tiles.both_ways(tiles.adjacency(df, keys), keys), keys)
    fragment = tiles.fragments(placed, keys).collect()
    assert [(r["fragment_index"], r["tile_count"], r["cols"], r["rows"], r["width"]) for r in fragment] == [(1, 3, 2, 2, 128)]
    assert [r["oversized"] for r in fragment] == [False]
    assert [(r["tile_index"], r["count"]) for r in tiles.single_tiles(df, placed, keys).collect()] == [(4, 2)]


def test_shared_edges_never_match(spark):
    rows = [("f", i, 64, 64, "same", "same" if i == 0 else None, None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "source_file string, tile long, w int, h int, left_edge string, right_edge string, top_edge string, bottom_edge string")
    assert tiles.adjacency(df, ["source_file"]).filter("right_of is not null").count() == 0
    assert tiles.adjacency(df.filter("tile < 8"), ["source_file"]).filter("right_of is not null").collect()[0]["right_of"] == 1
