"""Checked queries over files: inventory, records, paths, references, journal, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import obfuscation
from caseloom.functions import text as tx
from caseloom.harness.registry import check
from caseloom.harness.shapes import shape
from caseloom.plans import references, tasks_reports
from caseloom.sources import inventory, records, tiles

KEYS = ["host_id"]


def files(spark, sf):
    return shape(spark, sf, "files").withColumn("content", F.encode("text", "UTF-8")).withColumn("length", F.octet_length("text").cast("bigint")).drop("text")


@check("s8_file_discovery", "files", """
SELECT 'name' AS rule, path, doc_id FROM files WHERE lower(split_part(path, '/', -1)) IN ('system', 'sam') UNION ALL SELECT 'extension', path, doc_id FROM files WHERE lower(path) LIKE '%.wer'
UNION ALL SELECT 'suffix', path, doc_id FROM files WHERE lower(split_part(path, '/', -1)) LIKE '%ntuser.dat' UNION ALL SELECT 'content', path, doc_id FROM files WHERE contains(text, 'ation')""".strip())
def _(spark, sf):
    df = files(spark, sf)
    found = lambda rule, condition: df.filter(condition).select(F.lit(rule).alias("rule"), "path", "doc_id")
    return (
        found("name", inventory.named(["System", "SAM"])).unionByName(found("extension", inventory.with_suffix([".wer"])))
        .unionByName(found("suffix", inventory.with_suffix(["NTUSER.DAT"]))).unionByName(found("content", inventory.with_marker("ation")))
    )


@check("s9_content_dedupe", "files", """
SELECT length, min(path) AS path FROM (SELECT path, octet_length(encode(text)) AS length, md5(text) AS d FROM files) GROUP BY length, d""")
def _(spark, sf):
    return inventory.dedupe_by_content(files(spark, sf)).select("length", "path")


@check("s10_backup_copies", "files", """
SELECT path, doc_id FROM files f WHERE NOT contains(path, '/REGBACK/') OR NOT EXISTS (SELECT 1 FROM files g WHERE NOT contains(g.path, '/REGBACK/') AND upper(split_part(g.path, '/', -1)) = upper(split_part(f.path, '/', -1)))""")
def _(spark, sf):
    return inventory.without_backup_copies(shape(spark, sf, "files").select("path", "doc_id"), []).select("path", "doc_id")


MFT_SQL = """
best AS (SELECT entry, arg_max({'n': name, 'p': parent, 's': size}, (CASE namespace WHEN 'Win32' THEN 3 WHEN 'Win32AndDos' THEN 3 WHEN 'POSIX' THEN 2 ELSE 1 END, -attr_seq)) AS b FROM mfta WHERE kind = 'name' GROUP BY 1),
dat AS (SELECT entry, arg_max(size, attr_seq) AS d FROM mfta WHERE kind = 'data' AND name = '' GROUP BY 1),
rec AS (SELECT e.entry, b.b.n AS file_name, b.b.p AS parent_entry, CASE WHEN f // 2 % 2 = 1 THEN 'Y' ELSE 'N' END AS is_directory, CASE WHEN f % 2 = 1 THEN 'Y' ELSE 'N' END AS in_use, CAST(CASE WHEN f // 2 % 2 = 1 THEN 0 ELSE coalesce(d, b.b.s, 0) END AS BIGINT) AS file_size
  FROM (SELECT entry, max(flags) AS f FROM mfta GROUP BY 1) e JOIN best b USING (entry) LEFT JOIN dat USING (entry)),
recs AS (SELECT *, nullif(CASE WHEN is_directory = 'N' AND strpos(file_name, '.') > 1 THEN lower(split_part(file_name, '.', -1)) ELSE '' END, '') AS extension FROM rec)"""
PATH_SQL = MFT_SQL + """,
walk AS (SELECT entry, chr(92) || file_name AS path FROM recs WHERE parent_entry = 5 AND entry <> 5 UNION ALL SELECT r.entry, w.path || chr(92) || r.file_name FROM recs r JOIN walk w ON r.parent_entry = w.entry WHERE r.entry <> r.parent_entry),
paths AS (SELECT r.*, CASE WHEN entry = 5 OR file_name = '.' THEN chr(92) WHEN w.path IS NOT NULL THEN w.path WHEN r.parent_entry = r.entry THEN chr(92) || '$Orphan' || chr(92) || file_name || chr(92) || file_name ELSE chr(92) || '$Orphan' || chr(92) || file_name END AS path FROM recs r LEFT JOIN walk w USING (entry))"""


def mft(spark, sf):
    return records.file_records(shape(spark, sf, "mfta"), KEYS)


@check("s17_file_records", "mfta", MFT_SQL + " SELECT entry, file_name, parent_entry, is_directory, in_use, file_size, extension FROM recs")
def _(spark, sf):
    return mft(spark, sf).select("entry", "file_name", "parent_entry", "is_directory", "in_use", "file_size", "extension")


def located(spark, sf):
    return records.with_paths(mft(spark, sf), KEYS)


@check("s18_file_paths", "mfta", PATH_SQL + " SELECT entry, path FROM paths")
def _(spark, sf):
    return located(spark, sf).select("entry", "path")


@check("o7_folder_listing", "mfta", PATH_SQL + " SELECT entry, file_name, is_directory FROM paths WHERE parent_entry = 5 AND entry <> 5 UNION ALL SELECT entry, file_name, is_directory FROM paths WHERE parent_entry = 105 AND entry <> 105")
def _(spark, sf):
    rows = located(spark, sf)
    pick = lambda parent: references.children(rows, parent).select("entry", "file_name", "is_directory")
    return pick(5).unionByName(pick(105))


@check("o8_file_search", "mfta", PATH_SQL + " SELECT entry, path FROM paths WHERE contains(lower(file_name), 'nation_7') OR contains(lower(path), 'nation_7') ORDER BY is_directory DESC, lower(path), entry LIMIT 30")
def _(spark, sf):
    return references.search_files(located(spark, sf), "NATION_7", 30).select("entry", "path")


LINK_SQL = """
lr AS (SELECT _rowid, lower(replace(substr(target_path, 3), '/', chr(92))) AS path, regexp_extract(_source_file, '/(?:LNK|JumpList)/([^/]*)', 1) AS account, target_path AS label FROM links)"""


@check("c22_path_references", "links", LINK_SQL + " SELECT _rowid AS rowid, path, account, label, 'Jumplist' AS kind FROM lr")
def _(spark, sf):
    return references.path_references(shape(spark, sf, "links"), None).select("rowid", "path", "account", "label", "kind")


@check("c14_shell_folders", "", """
b AS (SELECT chr(92) || n_name AS p FROM nation UNION SELECT chr(92) || n_name || chr(92) || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT lower(p) AS path, 'acct1' AS account, 'C:' || p AS display FROM b""")
def _(spark, sf):
    return references.shellbag_folders(shape(spark, sf, "bags")).select("path", "account", "display")


@check("j7_referenced_files", "mfta links", PATH_SQL + "," + LINK_SQL + " SELECT DISTINCT p.entry, l.account, 'Jumplist' AS kind FROM paths p JOIN lr l ON lower(p.path) = l.path WHERE l.account IN ('acct1', 'acct2', 'acct3')")
def _(spark, sf):
    refs = references.path_references(shape(spark, sf, "links"), None)
    return references.file_tags(located(spark, sf), refs, ("acct1", "acct2", "acct3")).select("entry", "account", "kind")


@check("q16_files_with_references", "mfta links", PATH_SQL + "," + LINK_SQL + """ SELECT p.entry, p.path, count(DISTINCT l.account) AS accounts, CASE WHEN p.file_size <= 0 THEN NULL WHEN p.file_size < 1024 THEN p.file_size || ' B' WHEN p.file_size < 1048576 THEN printf('%.1f KB', floor(p.file_size / 102.4 + 0.5) / 10) ELSE printf('%.1f MB', floor(p.file_size / 104857.6 + 0.5) / 10) END AS shown_size
  FROM paths p LEFT JOIN lr l ON lower(p.path) = l.path GROUP BY p.entry, p.path, p.file_size""")
def _(spark, sf):
    rows = located(spark, sf)
    found = references.file_tags(rows, references.path_references(shape(spark, sf, "links"), None))
    counts = found.groupBy("host_id", "entry").agg(F.count_distinct("account").alias("accounts"))
    joined = rows.join(counts, ["host_id", "entry"], "left")
    return joined.select("entry", "path", F.coalesce("accounts", F.lit(0)).alias("accounts"), tx.listing_size(F.col("file_size").cast("string")).alias("shown_size"))


@check("u3_reference_dedupe", "links", LINK_SQL + " SELECT path, account, min(_rowid) AS rowid FROM lr GROUP BY 1, 2")
def _(spark, sf):
    refs = references.path_references(shape(spark, sf, "links"), None)
    return refs.groupBy("path", "account").agg(F.min("rowid").alias("rowid"))


def flags(column: str, table: list[tuple[int, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {column} // {bit} % 2 = 1 THEN '{name}' END" for bit, name in table)
    return f"nullif(concat_ws('|', {parts}), '')"


@check("s19_journal_flags", "usn", f"""
SELECT _rowid, {flags('reason', records.JOURNAL_REASONS)} AS reason, {flags('file_attributes', records.FILE_ATTRIBUTES)} AS file_attributes, file_reference % 281474976710656 AS mft_entry, parent_file_reference % 281474976710656 AS parent_mft_entry FROM usn""")
def _(spark, sf):
    return records.journal_records(shape(spark, sf, "usn")).select("_rowid", "reason", "file_attributes", "mft_entry", "parent_mft_entry")


TILE_KEYS = ["host_id", "source_file"]
TILE_SQL = """
lg AS (SELECT host_id, source_file, h, left_edge AS e, list(tile ORDER BY tile) AS ts FROM tiles WHERE left_edge IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) <= 8),
tg AS (SELECT host_id, source_file, w, top_edge AS e, list(tile ORDER BY tile) AS ts FROM tiles WHERE top_edge IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) <= 8),
adj AS (SELECT t.host_id, t.source_file, t.tile, list_filter(lg.ts, lambda x: x <> t.tile)[1] AS right_of, list_filter(tg.ts, lambda x: x <> t.tile)[1] AS down_of FROM tiles t
  LEFT JOIN lg ON lg.host_id = t.host_id AND lg.source_file = t.source_file AND lg.h = t.h AND lg.e = t.right_edge LEFT JOIN tg ON tg.host_id = t.host_id AND tg.source_file = t.source_file AND tg.w = t.w AND tg.e = t.bottom_edge)"""


def adjacency(spark, sf):
    return tiles.adjacency(shape(spark, sf, "tiles"), TILE_KEYS)


@check("s20_tile_adjacency", "tiles", TILE_SQL + " SELECT * FROM adj")
def _(spark, sf):
    return adjacency(spark, sf).select("host_id", "source_file", "tile", "right_of", "down_of")


@check("s20_inverse_links", "tiles", TILE_SQL + " SELECT a.source_file, a.tile, (SELECT max(tile) FROM adj b WHERE b.source_file = a.source_file AND b.right_of = a.tile) AS left_of, (SELECT max(tile) FROM adj b WHERE b.source_file = a.source_file AND b.down_of = a.tile) AS up_of FROM adj a")
def _(spark, sf):
    return tiles.both_ways(adjacency(spark, sf), TILE_KEYS).select("source_file", "tile", "left_of", "up_of")


@check("s21_picture_fragments")
def _(spark, sf):
    placed = tiles.components(tiles.both_ways(adjacency(spark, sf), TILE_KEYS), TILE_KEYS)
    return tiles.fragments(placed, TILE_KEYS)


@check("c10_bitmap_fragments")
def _(spark, sf):
    rows = shape(spark, sf, "tiles")
    placed = tiles.components(tiles.both_ways(adjacency(spark, sf), TILE_KEYS), TILE_KEYS)
    both = tiles.fragments(placed, TILE_KEYS).unionByName(tiles.single_tiles(rows, placed, TILE_KEYS), allowMissingColumns=True)
    return tasks_reports.bitmap_fragments(both)


@check("s22_distinct_tiles", "tiles", "SELECT source_file, min(tile) AS tile_index, count(*) AS count FROM tiles GROUP BY source_file, rgb")
def _(spark, sf):
    return tiles.distinct_tiles(shape(spark, sf, "tiles"), TILE_KEYS).select("source_file", "tile_index", "count")


@check("p2_kind_filter", "tiles", "SELECT source_file, tile FROM (SELECT *, CASE WHEN tile % 3 = 0 THEN 'fragment' ELSE 'tile' END AS kind FROM tiles) WHERE kind = 'fragment'")
def _(spark, sf):
    rows = shape(spark, sf, "tiles").withColumn("kind", F.when(F.col("tile") % 3 == 0, "fragment").otherwise("tile"))
    return tasks_reports.bitmap_fragments(rows).select("source_file", "tile")


@check("f39_normalised_variables")
def _(spark, sf):
    script = F.concat(F.lit("$a"), F.col("conv_id").cast("string"), F.lit(" = $env:x; ${B c} = $A"), F.col("conv_id").cast("string"), F.lit(" + "), "text")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", obfuscation.normalise_variables(script).alias("n"))
    return rows.select("conv_id", "turn", "n.code", F.size("n.legend").alias("names"))
