"""Host facts and configuration findings from registry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import hexbin, lookups, tags, times
from caseloom.functions import text as tx
from caseloom.functions.core import any_of, blank_to_null, first_present, text, with_computed
from caseloom.operators import ordered, payloads
from caseloom.plans.common import HOST, overview_row, union_all
from caseloom.session import cut_lineage
from caseloom.sources.raw import SCAN_TIES, hive, live_hives, scan_seq

# Value names and key endings of the facts.
OS_VALUES = ["ProductName", "EditionID", "DisplayVersion", "CurrentBuild", "RegisteredOwner", "InstallDate"]
CURRENT_VERSION = "\\microsoft\\windows nt\\currentversion"
HIDDEN_ACCOUNTS = "\\microsoft\\windows nt\\currentversion\\winlogon\\specialaccounts\\userlist"
NAMES_KEY = "\\sam\\domains\\account\\users\\names\\"
INTERFACES_KEY = "\\services\\tcpip\\parameters\\interfaces\\"
AUTORUN_KEYS = ["\\currentversion\\run", "\\currentversion\\runonce", "\\policies\\explorer\\run"]
LIST_VALUES = ["MRUList", "MRUListEx"]
SYSTEM_PICKS = [
    ("wdigest", "\\securityproviders\\wdigest", "UseLogonCredential"),
    ("ppl", "\\control\\lsa", "RunAsPPL"),
    ("server_start", "\\services\\lanmanserver", "Start"),
    ("auto_server", "\\lanmanserver\\parameters", "AutoShareServer"),
    ("auto_workstation", "\\lanmanserver\\parameters", "AutoShareWks"),
    ("computer_name", "\\control\\computername\\computername", "ComputerName"),
    ("time_zone", "\\control\\timezoneinformation", "TimeZoneKeyName"),
    ("shutdown", "\\control\\windows", "ShutdownTime"),
]


def _low_key() -> Column:
    return F.lower(text("key_path"))


def registry_picks(rows: DataFrame, picks: list[tuple[str, str, str]], keys: list[str] = HOST) -> DataFrame:
    """First non-empty value per pick, the first control set preferred; all picks in one aggregate per host."""
    low = _low_key()
    rank = F.struct((~low.contains("controlset001")).alias("other"), scan_seq().alias("seq"))
    wanted = any_of([low.endswith(suffix) & (F.col("value_name") == name) for _, suffix, name in picks])
    hits = rows.filter(wanted & (text("value_data") != ""))
    return hits.groupBy(*keys).agg(
        *[
            F.min_by("value_data", F.when(low.endswith(suffix) & (F.col("value_name") == name), rank)).alias(label)
            for label, suffix, name in picks
        ]
    )


def system_facts(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    software, system = hive(registry, "SOFTWARE"), hive(registry, "SYSTEM")
    os_rows = software.filter(_low_key().endswith(CURRENT_VERSION) & F.col("value_name").isin(*OS_VALUES))
    is_date = F.col("value_name") == "InstallDate"
    value = F.when(is_date, times.unix_seconds("value_data")).otherwise(blank_to_null("value_data"))
    usable = os_rows.withColumn("_value", value).filter(~is_date | F.col("_value").isNotNull())
    first = usable.groupBy(*keys, "value_name").agg(F.min_by(F.struct("_value"), scan_seq()).alias("v"))
    picks = registry_picks(system, SYSTEM_PICKS[5:], keys)
    named = picks.select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit("ComputerName").alias("n"), F.col("computer_name").alias("raw"), F.col("computer_name").alias("v")),
            F.struct(F.lit("TimeZone").alias("n"), F.col("time_zone").alias("raw"), F.col("time_zone").alias("v")),
            F.struct(F.lit("LastShutdownTime").alias("n"), F.col("shutdown").alias("raw"), hexbin.filetime_hex("shutdown").alias("v")),
        )).alias("f"),
    ).filter(F.col("f.raw").isNotNull())
    return union_all([
        overview_row(first, "TargetInfo", keys, category="SystemInfo", name=F.col("value_name"), value=F.col("v._value"), source_artifact="SOFTWARE"),
        overview_row(named, "TargetInfo", keys, category="SystemInfo", name=F.col("f.n"), value=F.col("f.v"), source_artifact="SYSTEM"),
    ])


def profiles(software: DataFrame, keys: list[str]) -> DataFrame:
    """Profile path per identifier (the last one wins) and the place the identifier was first seen."""
    rows = software.filter(_low_key().contains("\\profilelist\\s-") & (F.col("value_name") == "ProfileImagePath"))
    return rows.withColumn("sid", tx.last_segment("key_path")).groupBy(*keys, "sid").agg(
        F.max_by(text("value_data"), scan_seq()).alias("path"), F.min(scan_seq()).alias("seen")
    )


def accounts(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Local accounts with their profile, creation time and hidden mark, then profiles without an account."""
    sam, software = hive(registry, "SAM"), hive(registry, "SOFTWARE")
    prof = profiles(software, keys)
    prefix = prof.filter(F.col("sid").startswith("S-1-5-21-")).groupBy(*keys).agg(F.min_by("sid", "seen").alias("s"))
    prefix = prefix.select(*keys, F.regexp_replace("s", "-[^-]*$", "").alias("prefix"))

    low = _low_key()
    name_at = F.locate(NAMES_KEY, low)
    tail = F.substr(F.col("key_path"), name_at + len(NAMES_KEY))
    created = sam.filter((name_at > 0) & (tail != "") & ~tail.contains("\\")).withColumn("_name", F.lower(tail))
    created = created.groupBy(*keys, "_name").agg(F.max_by("last_write", scan_seq()).alias("created"))

    rid_hex = F.regexp_extract("key_path", r"(?i)\\users\\([0-9A-Fa-f]{8})$", 1)
    users = sam.filter((name_at == 0) & (rid_hex != "")).withColumn("_rid_hex", rid_hex)
    users = users.groupBy(*keys, "_rid_hex").agg(
        F.max_by("value_data", F.when(F.col("value_name") == "F", scan_seq())).alias("f"),
        F.max_by("value_data", F.when(F.col("value_name") == "V", scan_seq())).alias("v"),
    )
    hidden = software.filter(low.endswith(HIDDEN_ACCOUNTS) & (text("value_name") != "")).withColumn("_name", F.lower("value_name"))
    hidden = hidden.groupBy(*keys, "_name").agg(F.max_by(F.trim(text("value_data")), scan_seq()).alias("special"))

    for name, source in (("_fh", "f"), ("_vh", "v")):
        users = with_computed(users, name, hexbin.clean_hex(source))
    users = with_computed(users, "_f", hexbin.account_record(F.col("_fh")))
    users = with_computed(users, "_n", hexbin.account_names(F.col("_vh")))
    rid = F.conv("_rid_hex", 16, 10)
    local = (
        users.withColumn("rid", rid).withColumn("_name", F.lower("_n.username"))
        .join(prefix, keys, "left")
        .withColumn("sid", F.concat_ws("-", "prefix", "rid"))
        .withColumn("sid", F.when(F.col("prefix").isNotNull(), F.col("sid")))
    )
    local = local.join(prof.select(*keys, "sid", "path"), [*keys, "sid"], "left")
    local = local.join(created, [*keys, "_name"], "left").join(hidden, [*keys, "_name"], "left")
    special = F.when(F.col("special").isin("0", "0x0"), "yes (hidden from the logon screen)").when(
        F.col("special").isNotNull(), F.concat(F.lit("list value "), F.col("special")))
    f = lambda name: F.col(f"_f.{name}")
    path = blank_to_null("path")
    table = overview_row(
        local, "TargetInfo", keys, category="Account", name=F.col("sid"), value=path, source_artifact="SAM",
        username=F.col("_n.username"), full_name=F.col("_n.full_name"), rid=F.col("rid"), rid_sam=f("rid"), home_directory=path,
        created=F.col("created"), last_login=f("last_login"), password_last_set=f("password_last_set"),
        last_failed_login=f("last_failed_login"), login_count=f("login_count"), failed_login_count=f("failed_login_count"),
        disabled=f("disabled"), account_flags=f("account_flags"), special_account=special, timestamp=F.coalesce(f("last_login"), F.col("created")),
    )
    # Only the numbers of the accounts decide which profiles are left over.
    numbers = sam.filter((name_at == 0) & (rid_hex != "")).select(*keys, rid_hex.alias("_rid_hex")).distinct()
    owned = numbers.join(prefix, keys).select(*keys, F.concat_ws("-", "prefix", rid).alias("sid"))
    orphans = prof.join(owned, [*keys, "sid"], "left_anti")
    own_name = blank_to_null(tx.last_segment(F.regexp_replace("path", r"\\+$", "")))
    rest = overview_row(
        orphans, "TargetInfo", keys, category="Account", name=F.col("sid"), value=path, source_artifact="ProfileList",
        username=F.coalesce(lookups.service_name(F.col("sid")), own_name, F.col("sid")), home_directory=path,
    )
    return union_all([table, rest])


def rid_mismatches(target_info: DataFrame) -> DataFrame:
    """Accounts whose record number differs from the number of the key that holds it."""
    return target_info.filter((F.col("source_artifact") == "SAM") & F.col("rid_sam").isNotNull() & (F.col("rid") != F.col("rid_sam")))


def networks(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Network profiles: the values of one profile key become one row."""
    rows = hive(registry, "SOFTWARE").filter(_low_key().contains("\\networklist\\profiles\\{"))
    pick = lambda name: F.max_by(text("value_data"), F.when(F.col("value_name") == name, scan_seq()))
    found = rows.groupBy(*keys, "key_path").agg(pick("ProfileName").alias("n"), pick("DateLastConnected").alias("d"))
    return overview_row(
        found.filter(text("n") != ""), "TargetInfo", keys, category="Network", name="connected network", value=F.col("n"),
        timestamp=hexbin.systemtime_hex("d"), source_artifact="NetworkList",
    )


INTERFACE_VALUES = [
    "IPAddress", "DhcpIPAddress", "SubnetMask", "DhcpSubnetMask", "DefaultGateway", "DhcpDefaultGateway", "NameServer",
    "DhcpNameServer", "DhcpServer", "EnableDHCP", "Domain", "DhcpDomain", "LeaseObtainedTime", "LeaseTerminatesTime",
]


def network_interfaces(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    low = _low_key()
    at = F.locate(INTERFACES_KEY, low)
    guid = F.substring_index(F.substr(F.col("key_path"), at + len(INTERFACES_KEY)), "\\", 1)
    rows = hive(registry, "SYSTEM").filter((at > 0) & guid.startswith("{") & F.col("value_name").isin(*INTERFACE_VALUES)).withColumn("_guid", guid)
    wide = rows.groupBy(*keys, "_guid").agg(
        *[F.max_by(text("value_data"), F.when(F.col("value_name") == n, scan_seq())).alias(n) for n in INTERFACE_VALUES]
    )
    ip = F.coalesce(tx.address_list("IPAddress"), blank_to_null("DhcpIPAddress"))
    either = lambda a, b: F.coalesce(tx.address_list(a), blank_to_null(b))
    dhcp = F.when(F.col("EnableDHCP") == "1", "yes").when(F.col("EnableDHCP") == "0", "no")
    return overview_row(
        wide.withColumn("_ip", ip).filter(F.col("_ip").isNotNull() & (F.col("_ip") != "0.0.0.0")), "TargetInfo", keys,
        category="NetworkInterface", name=F.col("_guid"), value=F.col("_ip"), source_artifact="Tcpip",
        subnet_mask=either("SubnetMask", "DhcpSubnetMask"), gateway=either("DefaultGateway", "DhcpDefaultGateway"),
        dns_server=first_present("NameServer", "DhcpNameServer"), dhcp_server=blank_to_null("DhcpServer"), dhcp_enabled=dhcp,
        domain=first_present("Domain", "DhcpDomain"), lease_obtained=times.unix_seconds("LeaseObtainedTime"),
        lease_terminates=times.unix_seconds("LeaseTerminatesTime"),
    )


def _of_interest(registry: DataFrame, keys: list[str], parts: list[str], more: Column) -> DataFrame:
    """The rows that any branch can use, read once and kept in the shared folder: a small share of a registry.

    ``parts`` are key fragments in lower case. The branches test again what they need exactly.
    """
    low = _low_key()
    columns = [*keys, *[c for c in registry.columns if c not in keys]]
    return cut_lineage(registry.filter(any_of([low.contains(p) for p in parts]) | more).select(*columns))


def target_info(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Facts of each host: system, accounts, networks, interfaces."""
    parts = [CURRENT_VERSION, "\\profilelist\\s-", "\\sam\\domains\\account\\users\\", "\\networklist\\profiles\\{", INTERFACES_KEY]
    picked = any_of([_low_key().endswith(suffix) & (F.col("value_name") == name) for _, suffix, name in SYSTEM_PICKS[5:]])
    registry = _of_interest(registry, keys, parts, picked | _low_key().rlike(r"\\users\\[0-9a-f]{8}$"))
    return union_all([system_facts(registry, keys), accounts(registry, keys), networks(registry, keys), network_interfaces(registry, keys)])


def deduplicated_facts(info: DataFrame, order: list[str], keys: list[str] = HOST) -> dict[str, DataFrame]:
    """Display facts by the order of the rows, which the named columns give: the rows without repetitions, the first non-empty
    value per system fact (null if it has none), the latest time per network, the first row per interface and address.

    All are aggregates with a partial step, so repeated rows are combined before the shuffle.
    """
    place = F.struct(*order)

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, *by)]
        return rows.groupBy(*keys, *by).agg(F.min_by(F.struct(*rest), place).alias("_first")).select(*keys, *by, "_first.*")

    category, shown = F.col("category"), first_present("value", "timestamp")
    return {
        "rows": first(info, ["category", "name", "value", "timestamp"]),
        "system": info.filter(category.isin("SystemInfo", "OS", "System")).groupBy(*keys, "name").agg(F.min_by(shown, F.when(shown.isNotNull(), place)).alias("value")),
        "networks": info.filter(category == "Network").groupBy(*keys, F.col("value").alias("name")).agg(F.max("timestamp").alias("timestamp")),
        "interfaces": first(info.filter((category == "NetworkInterface") & F.col("value").isNotNull()), ["value", "name"]),
    }


def host_addresses(info: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """One row per interface address; an address two hosts claim belongs to the first."""
    faces = info.filter(F.col("category") == "NetworkInterface")
    each = faces.select(*keys, F.explode(F.split("value", ", ")).alias("ip"))
    return each.groupBy("ip").agg(F.min("host_id").alias("peer_host"))


def with_peer_host(rows: DataFrame, addresses: DataFrame) -> DataFrame:
    """Known host behind a remote address; unknown addresses stay. The map grows with the case, so no forced broadcast."""
    return rows.join(addresses.withColumnRenamed("ip", "remote_address"), "remote_address", "left")


# Findings ---------------------------------------------------------------------------------------------------------

def credential_protection(picks: DataFrame, keys: list[str]) -> DataFrame:
    w, p = F.col("wdigest"), F.col("ppl")
    protected = p.isin("1", "2")
    rows = picks.select(*keys, F.explode(F.array(
        F.struct(
            F.lit("WDigest UseLogonCredential").alias("name"), F.lit("…\\Control\\SecurityProviders\\WDigest").alias("key_path"),
            F.when(w == "1", "1 (on)").when(w == "0", "0 (off)").otherwise("not set (default)").alias("value"),
            F.when(w == "1", "suspicious").when(w == "0", "normal").otherwise("info").alias("status"),
            F.when(w == "1", "plaintext credential cache is on").when(w == "0", "plaintext credential cache is off")
            .otherwise("not set; recent systems default to off").alias("detail"),
        ),
        F.struct(
            F.lit("LSASS protection (RunAsPPL)").alias("name"), F.lit("…\\Control\\Lsa").alias("key_path"),
            F.when(protected, F.concat(p, F.lit(" (on)"))).otherwise("not set").alias("value"),
            F.when(protected, "normal").otherwise("caution").alias("status"),
            F.when(protected, "runs as a protected process").otherwise("does not run as a protected process").alias("detail"),
        ),
    )).alias("f"))
    return overview_row(
        rows, "RegistryFindings", keys, category="credential protection", source="SYSTEM",
        **{c: F.col(f"f.{c}") for c in ("name", "value", "status", "detail", "key_path")},
    )


def share_path(value: Column | str) -> Column:
    """``Path=`` item of a share definition."""
    raw = text(value)
    items = F.when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))
    hit = F.filter(items, lambda x: F.lower(x).startswith("path="))
    return F.substr(F.get(hit, F.lit(0)), F.lit(6))


def shares(system: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    start = F.col("server_start")
    running = start.isin("2", "3")
    service = overview_row(
        picks.filter(start.isNotNull()), "RegistryFindings", keys, category="shares", name="file server service",
        value=F.when(start == "2", "automatic").when(start == "3", "manual").when(start == "4", "disabled").otherwise(start),
        status=F.when(running, "info").otherwise("normal"),
        detail=F.when(running, "the sharing service runs").otherwise("the sharing service is disabled"),
        key_path="…\\Services\\LanmanServer", source="SYSTEM",
    )
    automatic = [
        overview_row(
            picks.filter(F.col(column) == "0"), "RegistryFindings", keys, category="shares", name=f"administrative shares ({value_name})",
            value="0 (off)", status="info", detail=f"default administrative shares are off ({role})",
            key_path="…\\LanmanServer\\Parameters", source="SYSTEM",
        )
        for column, value_name, role in [
            ("auto_server", "AutoShareServer", "server"), ("auto_workstation", "AutoShareWks", "workstation")]
    ]
    own = system.filter(_low_key().endswith("\\lanmanserver\\shares") & ~text("value_name").isin("", "(default)"))
    own = ordered.first_per_key(own, [*keys, "value_name"], scan_seq())
    user_shares = overview_row(
        own, "RegistryFindings", keys, category="shares", name=F.col("value_name"),
        value=F.coalesce(blank_to_null(share_path("value_data")), blank_to_null("value_data")), status="caution",
        detail="user-defined share; check exposure and permissions", key_path=F.col("key_path"), source="SYSTEM", timestamp=F.col("last_write"),
    )
    return union_all([service, *automatic, user_shares])


def sql_instance(key_path: Column | str) -> Column:
    """Instance label with its product year, from the first versioned key segment."""
    parts = F.split(F.col(key_path) if isinstance(key_path, str) else key_path, r"\\")
    inst = F.get(F.filter(parts, lambda p: F.upper(p).startswith("MSSQL") & p.contains(".")), F.lit(0))
    version = F.replace(F.upper(F.substring_index(inst, ".", 1)), F.lit("MSSQL"), F.lit(""))
    name = blank_to_null(F.regexp_extract(inst, r"^[^.]*\.(.*)$", 1))
    year = F.when(F.lit(False), F.lit(""))
    for number, label in lookups.SQL_SERVER_YEARS.items():
        year = year.when(version == number, label)
    label = F.coalesce(name, inst)
    return F.when(year.isNotNull(), F.concat(label, F.lit(" · SQL Server "), year)).otherwise(label)


def sql_authentication(software: DataFrame, keys: list[str]) -> DataFrame:
    rows = software.filter((F.col("value_name") == "LoginMode") & _low_key().contains("microsoft sql server"))
    mode, label = text("value_data"), sql_instance("key_path")
    return overview_row(
        rows, "RegistryFindings", keys, category="SQL authentication", key_path=F.col("key_path"), source="SOFTWARE",
        name=F.when(label.isNotNull(), F.concat(F.lit("LoginMode — "), label)).otherwise("LoginMode"),
        value=F.when(mode == "1", "Windows authentication only").when(mode == "2", "mixed mode").otherwise(F.concat(F.lit("unknown("), mode, F.lit(")"))),
        status=F.when(mode == "2", "caution").when(mode == "1", "normal").otherwise("info"),
        detail=F.when(mode == "2", "mixed mode; database accounts can log in").when(mode == "1", "only Windows authentication").otherwise("check the mode"),
    )


def hive_user(name: Column | str) -> Column:
    """Account of a hive by its file name."""
    value = F.col(name) if isinstance(name, str) else name
    up = F.upper(value)
    return F.when(up == "SOFTWARE", "(system)").when(up == "DEFAULT", ".DEFAULT").otherwise(
        F.regexp_replace(value, r"(?i)_NTUSER\.DAT$", ""))


def autoruns(rows: DataFrame, keys: list[str]) -> DataFrame:
    low = _low_key()
    hits = rows.filter(any_of([low.endswith(s) for s in AUTORUN_KEYS]) & ~text("value_name").isin("", "(default)"))
    kind = F.when(low.endswith("runonce"), "RunOnce").when(low.contains("policies"), "Policy Run").otherwise("Run")
    command = blank_to_null("value_data")
    return overview_row(
        hits, "RegistryFindings", keys, category="autorun", name=F.col("value_name"), value=command, status="info", detail=kind,
        command=command, user=hive_user("hive"), key_path=F.col("key_path"), source=F.col("hive"), timestamp=F.col("last_write"),
    )


def execution_traces(rows: DataFrame, keys: list[str]) -> DataFrame:
    low = _low_key()
    named = rows.filter(~text("value_name").isin("", "(default)", *LIST_VALUES))
    is_run, is_typed = low.endswith("\\explorer\\runmru"), low.endswith("\\explorer\\typedpaths")
    command = blank_to_null(F.regexp_replace("value_data", r"\\1$", ""))
    return overview_row(
        named.filter(is_run | is_typed), "RegistryFindings", keys, category="other", status="info",
        subtype=F.when(is_run, "RunMRU").otherwise("TypedPaths"), name=F.when(is_run, "RunMRU").otherwise("TypedPath"),
        value=F.when(is_run, command).otherwise(blank_to_null("value_data")), command=F.when(is_run, command),
        user=hive_user("hive"), key_path=F.col("key_path"), source=F.col("hive"), timestamp=F.col("last_write"),
    )


def compatibility_cache(system: DataFrame, keys: list[str]) -> DataFrame:
    """Programs of the compatibility cache; the first entry of a path is kept."""
    blobs = system.filter(F.col("value_name") == "AppCompatCache")
    hexed = blobs.select(*keys, *SCAN_TIES, hexbin.clean_hex("value_data").alias("_blob"))
    entries = hexed.lateralJoin(payloads.ShimcacheEntries(F.col("_blob").outer()))
    first = entries.groupBy(*keys, "path").agg(F.min_by("ticks", F.struct(*SCAN_TIES, "at")).alias("ticks"))
    return overview_row(
        first, "RegistryFindings", keys, category="other", subtype="ShimCache", name="ShimCache (AppcompatCache)", value=F.col("path"),
        status="info", timestamp=times.filetime(F.col("ticks")), key_path="…\\Control\\Session Manager\\AppCompatCache", source="SYSTEM",
    )


def registry_findings(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    hosts = registry.select(*keys).distinct()
    parts = ["\\lanmanserver\\shares", "microsoft sql server", *AUTORUN_KEYS, "\\explorer\\runmru", "\\explorer\\typedpaths"]
    picked = any_of([_low_key().endswith(suffix) & (F.col("value_name") == name) for _, suffix, name in SYSTEM_PICKS[:5]])
    registry = _of_interest(registry, keys, parts, picked | (F.col("value_name") == "AppCompatCache"))
    system, software, every = hive(registry, "SYSTEM"), hive(registry, "SOFTWARE"), live_hives(registry)
    # A host without any of the values still gets its credential findings.
    picks = hosts.join(registry_picks(system, SYSTEM_PICKS[:5], keys), keys, "left")
    return union_all([
        credential_protection(picks, keys), shares(system, picks, keys), sql_authentication(software, keys),
        autoruns(every, keys), execution_traces(every, keys), compatibility_cache(system, keys),
    ])


# Fixed value: display order of the finding groups.
CATEGORY_ORDER = ["credential protection", "shares", "SQL authentication", "autorun", "other"]


def finding_display(findings: DataFrame) -> DataFrame:
    """Current names for rows of older databases; an autorun whose command matches a path rule is suspicious."""
    legacy_run = F.col("name") == "Run 대화상자 입력 (RunMRU)"
    typed = text("subtype") == "TypedPaths"
    legacy_typed = F.col("name") == "탐색기 주소 입력 (TypedPaths)"
    name = (
        F.when(text("subtype") == "ShimCache", "ShimCache (AppcompatCache)").when(typed | legacy_typed, "TypedPath")
        .when(legacy_run, "RunMRU").otherwise(F.col("name"))
    )
    tagged = (F.col("category") == "autorun") & (F.size(tags.path_tags(first_present("command", "value"))) > 0)
    return findings.withColumn("name", name).withColumn("status", F.when(tagged, "suspicious").otherwise(F.col("status")))


def finding_groups(findings: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Rows per group and sub-tab: autoruns by user, other traces by subtype."""
    tab = F.when(F.col("category") == "autorun", first_present("user", F.lit("(other)"))).when(
        F.col("category") == "other", first_present("subtype", F.lit("(other)")))
    position = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category")), F.lit(0)), F.lit(99))
    return findings.groupBy(*keys, position.alias("position"), "category", tab.alias("tab")).agg(F.count(F.lit(1)).alias("rows"))
