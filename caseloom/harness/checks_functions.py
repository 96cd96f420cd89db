"""Checked queries of the scalar functions, on texts and numbers made from the customers' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import hexbin, times, urls
from caseloom.functions import text as tx
from caseloom.harness.registry import check
from caseloom.harness.shapes import SHAPES, filetime, kst, le, shape
from caseloom.plans import registry_facts as rf

SHAPES["texts"] = """
SELECT k, CASE k % 6 WHEN 0 THEN @'C:\\Dir\\' || c_name || '.exe' WHEN 1 THEN '/usr/share/' || c_name WHEN 2 THEN c_name WHEN 3 THEN @'D:/Mixed\\' || c_name || @'\\/' WHEN 4 THEN '' ELSE @'\\\\Server\\Share\\' || c_name END AS path,
  CASE k % 6 WHEN 0 THEN @'CORP\\User' || @n(k) WHEN 1 THEN 'User' || @n(k) || '@corp.example' WHEN 2 THEN @' CORP/User ' WHEN 3 THEN '' WHEN 4 THEN '@only' ELSE c_name END AS account,
  CASE k % 5 WHEN 0 THEN @'"C:\\P F\\app' || @n(k) || '.exe" -x y' WHEN 1 THEN @'C:\\b' || @n(k) || '.exe -nop' WHEN 2 THEN '' WHEN 3 THEN @'"C:\\open' ELSE 'plain' END AS command,
  CASE k % 4 WHEN 0 THEN chr(10) || '   first ' || c_name || chr(13) || chr(10) || 'second' WHEN 1 THEN '' WHEN 2 THEN 'one' || chr(10) ELSE chr(10) || '  ' || chr(10) END AS lines,
  CASE k % 4 WHEN 0 THEN 'Severity = Info' || chr(10) || ' Host Application = app' || @n(k) || chr(13) || chr(10) || 'Host Application = other' WHEN 1 THEN 'no label' WHEN 2 THEN ' Command Name =' ELSE 'UserId=u' || @n(k) || chr(13) || chr(10) || 'x' END AS context,
  CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN '-5' WHEN 2 THEN 'x' WHEN 3 THEN @n(k) WHEN 4 THEN @n(k * 1000 + 7) WHEN 5 THEN @n(k * 1000003) WHEN 6 THEN @n(k * 10000000019) WHEN 7 THEN @n(k * 1000000000039) ELSE ' 1023 ' END AS amount,
  CASE k % 6 WHEN 0 THEN 'https://user:pw@WWW.Host' || @n(k) || '.Example.:8080/x?y' WHEN 1 THEN 'http://a.b/' || @n(k) WHEN 2 THEN 'file:///C:/x' WHEN 3 THEN 'no url' WHEN 4 THEN 'ftp://h' || @n(k) || '#f' ELSE '' END AS url,
  CASE k % 6 WHEN 0 THEN '["10.0.0.' || @n(k % 250) || '", "0.0.0.0", ""]' WHEN 1 THEN '10.1.1.1' WHEN 2 THEN '0.0.0.0' WHEN 3 THEN '' WHEN 4 THEN '["0.0.0.0"]' ELSE ' 10.2.2.' || @n(k % 9) || ' ' END AS addresses,
  CASE k % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'disabled' WHEN 4 THEN '0' WHEN 5 THEN 'maybe' WHEN 6 THEN '' ELSE 'No' END AS word,
  CASE k % 4 WHEN 0 THEN 'MaxXMLSize' WHEN 1 THEN 'userID-Name' WHEN 2 THEN 'already_there' ELSE 'HTTPServer' || @n(k) END AS camel,
  CASE k % 5 WHEN 0 THEN 'odd' WHEN 1 THEN '' ELSE @le8[133000000000000000 + k * 864000000005] || @le4[k] || @le2[k % 65536] END AS raw_hex, @wide[c_name] AS wide_hex,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'x' ELSE @n(13348540800000000 + k * 1234567) END AS chrome,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '-1' WHEN 2 THEN 'x' ELSE ' ' || @n(1704067200 + k * 61) END AS unix,
  CASE k % 5 WHEN 0 THEN @at[k * 61] WHEN 1 THEN '' WHEN 2 THEN 'yesterday' WHEN 3 THEN '2024-13-01 00:00:00.000' ELSE @at[k] END AS stamp,
  CASE k % 6 WHEN 0 THEN '2024-01-02T03:04:05Z' WHEN 1 THEN '2024-01-02T03:04:05.25+01:00' WHEN 2 THEN @n(1704067200 + k) WHEN 3 THEN @n(1704067200000 + k) WHEN 4 THEN 'soon' ELSE '2024-01-02 03:04:05' END AS iso,
  CASE k % 4 WHEN 0 THEN 'SOFTWARE' WHEN 1 THEN 'Default' WHEN 2 THEN c_name || '_NTUSER.DAT' ELSE 'user' || @n(k) || '_ntuser.dat' END AS hive_name,
  CASE k % 4 WHEN 0 THEN '["CATimeout=0", "Path=C:\\\\\\\\Share' || @n(k) || '"]' WHEN 1 THEN 'path=D:/x' WHEN 2 THEN '["a"]' ELSE '' END AS share
FROM (SELECT c_custkey AS k, c_name FROM @t(customer))
"""

LAST = r"regexp_extract({}, '([^\\/]*)$', 1)"
TRIMMED = r"regexp_replace(path, '[\\/]+$', '')"
BARE = "nullif(trim(split_part(" + LAST.format("{}") + ", chr(64), 1)), '')"


def scalar(name, sql, source="texts", **columns):
    """A query that applies column functions to every row of the texts."""
    @check(name, "texts", f"SELECT k, {sql} FROM {source}")
    def _(spark, sf):
        return shape(spark, sf, "texts").select("k", *[value().alias(alias) for alias, value in columns.items()])


scalar("f1_bare_account", f"{BARE.format('account')} AS v", v=lambda: tx.bare_account("account"))
scalar("f2_normalised_account", f"lower({BARE.format('trim(account)')}) AS v", v=lambda: tx.normalised_account("account"))
scalar("f3_last_segments", f"{LAST.format('path')} AS last, coalesce(nullif({LAST.format(TRIMMED)}, ''), path) AS base",
       last=lambda: tx.last_segment("path"), base=lambda: tx.trimmed_basename("path"))
scalar("f4_host_executable", f"coalesce(nullif({LAST.format('p')}, ''), nullif(p, '')) AS v", """(SELECT *, CASE WHEN starts_with(trim(command), '"') THEN regexp_extract(trim(command), '^"([^"]*)', 1) ELSE split_part(trim(command), ' ', 1) END AS p FROM texts)""",
       v=lambda: tx.exe_from_host("command"))
scalar("f5_first_line", r"nullif(list_filter(list_transform(string_split_regex(lines, '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1], '') AS v", v=lambda: tx.first_line("lines"))
scalar("f6_labelled_values", r"""nullif(trim(regexp_extract(list_filter(string_split_regex(context, '\r?\n'), lambda x: contains(x, '=') AND contains(split_part(x, '=', 1), 'Host Application'))[1], '^[^=]*=(.*)$', 1)), '') AS host,
  nullif(trim(regexp_extract(context, 'UserId=([^\r\n]*)', 1)), '') AS usr""", host=lambda: tx.labelled_value("context", ["Host Application"]), usr=lambda: tx.after_token("context", "UserId="))
scalar("f7_volume_relative", r"CASE WHEN regexp_matches(lower(path), '^[a-z]:') THEN CASE WHEN substr(replace(path, '/', chr(92)), 3, 1) = chr(92) THEN '' ELSE chr(92) END || substr(replace(lower(path), '/', chr(92)), 3) ELSE replace(lower(path), '/', chr(92)) END AS v",
       v=lambda: tx.volume_relative("path"))
scalar("f9_human_bytes", """CASE WHEN n < 0 OR n IS NULL THEN NULL WHEN n < 1024 THEN n || ' B' WHEN n < 1024 ** 2 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1024 ** 3 THEN printf('%.1f MB', n / 1024.0 ** 2)
  WHEN n < 1024 ** 4 THEN printf('%.1f GB', n / 1024.0 ** 3) ELSE printf('%.1f TB', n / 1024.0 ** 4) END AS v""", "(SELECT k, try_cast(trim(amount) AS BIGINT) AS n FROM texts)", v=lambda: tx.human_bytes("amount"))
scalar("f9_listing_size", """CASE WHEN NOT n > 0 OR n IS NULL THEN NULL WHEN n < 1024 THEN n || ' B' WHEN n < 1024 ** 2 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1024 ** 3 THEN printf('%.1f MB', n / 1024.0 ** 2)
  ELSE printf('%.2f GB', n / 1024.0 ** 3) END AS v""", "(SELECT k, try_cast(trim(amount) AS BIGINT) AS n FROM texts)", v=lambda: tx.listing_size("amount"))
scalar("f10_url_domain", r"CASE WHEN NOT starts_with(url, 'file:') THEN nullif(rtrim(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+:/+([^/?#]*)', 1), '^.*' || chr(64), ''), ':\d*$', '')), '.'), '') END AS v", v=lambda: urls.url_domain("url"))
scalar("f11_rot13", "@rot[path] AS v", v=lambda: tx.rot13("path"))
scalar("f12_clean_hex", "CASE WHEN raw_hex = 'odd' THEN '' ELSE raw_hex END AS v, CASE WHEN raw_hex = 'odd' THEN 0 ELSE len(raw_hex) // 2 END AS n", v=lambda: hexbin.clean_hex("raw_hex"), n=lambda: hexbin.byte_length(hexbin.clean_hex("raw_hex")))
scalar("f13_little_endian", ", ".join(f"CASE WHEN len(raw_hex) < 28 THEN 0 ELSE {le('raw_hex', at, width)} END AS n{width}" for at, width in ((12, 2), (8, 4), (0, 8))),
       n2=lambda: hexbin.le_uint(hexbin.clean_hex("raw_hex"), 12, 2), n4=lambda: hexbin.le_uint(hexbin.clean_hex("raw_hex"), 8, 4), n8=lambda: hexbin.le_uint(hexbin.clean_hex("raw_hex"), 0, 8))
scalar("f14_filetime", f"CASE WHEN len(raw_hex) >= 28 THEN {filetime('133000000000000000 + k * 864000000005')} END AS v, {filetime('k - 100')} AS early",
       v=lambda: times.filetime(hexbin.le_uint(hexbin.clean_hex("raw_hex"), 0, 8)), early=lambda: times.filetime(F.col("k").cast("bigint") - 100))
scalar("f15_browser_and_unix_time", f"CASE WHEN k % 4 = 3 THEN {kst('13348540800000000 + k * 1234567 - 11644473600000000')} END AS chrome, CASE WHEN k % 4 = 3 THEN {kst('(1704067200 + k * 61) * 1000000')} END AS unix, {kst('(45000 + k - 25569) * 86400000000 + 43200000000')} AS ole",
       chrome=lambda: times.chrome_time("chrome"), unix=lambda: times.unix_seconds("unix"), ole=lambda: times.ole_days(F.col("k") + F.lit(45000.5)))
scalar("f16_hex_times", f"CASE WHEN len(raw_hex) >= 28 THEN {filetime('133000000000000000 + k * 864000000005')} END AS v", v=lambda: hexbin.filetime_hex("raw_hex"))
_HALF_EVEN = "{0} // 1000 + CASE WHEN {0} % 1000 > 500 OR ({0} % 1000 = 500 AND {0} // 1000 % 2 <> 0) THEN 1 ELSE 0 END"
scalar("f17_nanosecond_time", f"{kst('(' + _HALF_EVEN.format('(1704067200000000000 + k * 61000000250)') + ')')} AS v, {kst('(' + _HALF_EVEN.format('(999000 + k * 250)') + ')')} AS near",
       v=lambda: times.filetime_ns(F.col("k") * F.lit(61_000_000_250) + F.lit(1_704_067_200_000_000_000)), near=lambda: times.filetime_ns(F.col("k") * F.lit(250) + F.lit(999_000)))
scalar("f18_display_time", f"CASE k % 6 WHEN 0 THEN {kst('1704164645000000')} WHEN 1 THEN {kst('1704161045250000')} WHEN 5 THEN '2024-01-02 03:04:05.000' ELSE iso END AS v", v=lambda: times.zoned_or_local_time("iso"))
scalar("f19_epoch_millis", "CASE WHEN k % 5 IN (0, 4) THEN epoch_ms(CAST(stamp AS TIMESTAMP)) END AS v", v=lambda: times.epoch_millis("stamp"))
scalar("f21_payload_time", f"CASE k % 6 WHEN 0 THEN {kst('1704164645000000')} WHEN 1 THEN {kst('1704161045250000')} WHEN 2 THEN {kst('(1704067200 + k) * 1000000')} WHEN 3 THEN {kst('(1704067200000 + k) * 1000')} WHEN 5 THEN '2024-01-02 03:04:05.000' END AS v", v=lambda: times.payload_time("iso"))
scalar("f28_address_list", "CASE k % 6 WHEN 0 THEN '10.0.0.' || k % 250 WHEN 1 THEN '10.1.1.1' WHEN 5 THEN trim(addresses) END AS v", v=lambda: tx.address_list("addresses"))
scalar("f29_wide_text", "'Customer#' || lpad(CAST(k AS VARCHAR), 9, '0') AS v", v=lambda: hexbin.utf16_text(F.col("wide_hex")))
scalar("f30_truth_value", "CASE WHEN k % 8 < 3 THEN true WHEN k % 8 IN (3, 4, 7) THEN false END AS v", v=lambda: tx.truth_value("word"))
scalar("f37_hive_user", "CASE k % 4 WHEN 0 THEN '(system)' WHEN 1 THEN '.DEFAULT' WHEN 2 THEN replace(hive_name, '_NTUSER.DAT', '') ELSE 'user' || k END AS v", v=lambda: rf.hive_user("hive_name"))
scalar("f37_share_path", "CASE k % 4 WHEN 0 THEN 'C:' || chr(92) || 'Share' || k WHEN 1 THEN 'D:/x' END AS v", v=lambda: rf.share_path("share"))
scalar("f40_snake_case", "CASE k % 4 WHEN 0 THEN 'max_xml_size' WHEN 1 THEN 'user_id_name' WHEN 2 THEN camel ELSE 'http_server' || k END AS v", v=lambda: tx.snake_case("camel"))
