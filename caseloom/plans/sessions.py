"""Remote-access sessions and peer ledgers for analysts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import times
from caseloom.functions.core import text
from caseloom.functions.text import bare_account
from caseloom.operators import ordered, rollups
from caseloom.plans.common import HOST
from caseloom.plans.registry_facts import with_peer_host
from caseloom.sources.raw import SCAN_TIES

SESSION_GAP_MS = 10 * 60 * 1000
# Place of rows without a readable time: after the year 9999.
UNREADABLE_MS = 253_402_300_800_000


def remote_sessions(history: DataFrame, keys: list[str] = HOST, gap_ms: int = SESSION_GAP_MS,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """History rows with their session. Works on every history with a direction and a remote address.

    A row whose time cannot be read follows the others of its host, by its text; it neither opens nor closes a gap.
    """
    rows = history.filter(F.col("timestamp").isNotNull() & times.in_range("timestamp", start, end))
    rows = rows.withColumn("account", bare_account("account")).withColumn("_at", times.epoch_millis("timestamp"))
    rows = rows.withColumn("_t", F.coalesce("_at", F.lit(UNREADABLE_MS))).withColumn("_late", F.when(F.col("_at").isNull(), F.col("timestamp")).otherwise(""))
    order = ordered.ScanOrder(tuple(keys), "_t", ("_late", *SCAN_TIES))
    return ordered.cluster_sessions(rows, order, gap_ms, "direction", "remote_address", measured="_at").drop("_at", "_late")


def session_table(sessions: DataFrame, keys: list[str] = HOST) -> DataFrame:
    return rollups.session_rollup(sessions, keys, F.struct("_t", *SCAN_TIES))


def filter_sessions(table: DataFrame, addresses: DataFrame | None = None, direction: str | None = None,
                    outcome: str = "all", search: str = "") -> DataFrame:
    """Sessions by direction, outcome and text in address, account or the known host behind the address."""
    rows = with_peer_host(table, addresses) if addresses is not None else table.withColumn("peer_host", F.lit(None).cast("string"))
    if direction:
        rows = rows.filter(F.col("direction") == direction)
    if outcome in ("success", "fail"):
        rows = rows.filter(F.col(outcome) > 0)
    if search.strip():
        needle = search.strip().lower()
        rows = rows.filter(
            F.lower(text("remote_address")).contains(needle) | F.lower(text("account")).contains(needle)
            | F.lower(text("peer_host")).contains(needle)
        )
    return rows


def peers(history: DataFrame, keys: list[str] = HOST, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = history.filter(times.in_range("timestamp", start, end)).withColumn("account", bare_account("account"))
    return rollups.peer_ledger(rows, keys)


def filter_peers(history: DataFrame, keys: list[str] = HOST, outcome: str = "all", search: str = "",
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """Ledger rows by outcome and text in the address or in one of its accounts."""
    rows = history.filter(times.in_range("timestamp", start, end)).withColumn("account", bare_account("account"))
    ledger = rollups.peer_ledger(rows, keys)
    if outcome in ("success", "fail"):
        ledger = ledger.filter(F.col(outcome) > 0)
    if search.strip():
        needle = search.strip().lower()
        by_account = rollups.peer_accounts(rows, keys).filter(F.lower("account").contains(needle))
        by_account = by_account.select(*keys, "peer").distinct().withColumn("_hit", F.lit(True))
        ledger = ledger.join(by_account, [*keys, "peer"], "left")
        ledger = ledger.filter(F.col("_hit").isNotNull() | F.lower("peer").contains(needle)).drop("_hit")
    return ledger


def peer_order():
    return [F.desc("attempts"), F.asc("peer")]
