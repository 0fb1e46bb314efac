"""Audit of an access log against an allowlist of addresses and networks."""

from pyspark.sql import DataFrame, functions as F

from meterfold import fixed_values as fv
from meterfold.functions.net import address_key, in_ranges, parse_ranges, with_client_hex


def audit_access(
    log: DataFrame,
    allowed_ips: str,
    header: str = "x_forwarded_for",
    allow_all_when_unset: bool = True,
) -> DataFrame:
    """Add ``client_hex`` and ``allowed`` to every log row.

    The setting becomes disjoint ranges of addresses in order, and a row finds the one range that can
    hold its address by binary search: no join and no shuffle, and a list of any length takes the
    same path, one comparison more each time it doubles.
    """
    ranges = parse_ranges(allowed_ips)
    log = with_client_hex(log, header, "client_hex")
    allowed = in_ranges(address_key(F.col("client_hex")), ranges) if ranges else F.lit(allow_all_when_unset)
    return log.withColumn("allowed", allowed)


def refusals(audited: DataFrame) -> DataFrame:
    """Refused requests with their outcome fields."""
    return audited.where(~F.col("allowed")).withColumns({
        "http_status": F.lit(403), "erreur": F.lit(fv.IP_REFUSED),
        "message": F.lit(fv.TEXT["ip_refused"]),
    })
