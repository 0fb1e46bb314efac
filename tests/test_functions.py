import ipaddress
import random
from datetime import date, datetime

from pyspark.sql import functions as F

from meterfold.fixed_values import BOOLEAN_DIALECTS, WHITESPACE
from meterfold.functions import booleans, dates, net, payload, text


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in out]


def test_strip_equals_python_strip(spark):
    ends = ["", " ", "\t", "\n", " ", "  ", " 　", "\x1f", "\x85"]
    values = [a + b + c for a in ends for b in ("", "x", "é x", "a\tb") for c in ends] + [None]
    assert column(spark, values, text.strip) == [v if v is None else v.strip() for v in values]
    assert column(spark, values, text.clean) == [(v.strip() or None) if v else None for v in values]
    assert all(c.isspace() for c in WHITESPACE)


def test_patterns_and_lengths(spark):
    mails = ["a@b.fr", "pas-un-email", "a b@c.fr", "a@b", "é@x.y", None, "x" * 95 + "@mail.fr"]
    assert column(spark, mails, text.is_email) == [True, False, False, False, True, False, False]
    codes = ["75001", "7500", "7500A", "750011", None]
    assert column(spark, codes, text.is_postal_code) == [True, False, False, False, False]
    assert column(spark, ["é" * 5, "é" * 6, None], lambda c: text.longer_than(c, 5)) == [
        False, True, False]
    assert column(spark, [" 12 ", "0", "101", "x", "-1", "1.5", None],
                  lambda c: text.bounded_int(c, 1, 100)) == [12, None, None, None, None, None, None]
    assert column(spark, [1.5, float("nan"), None], text.number, "double") == [1.5, None, None]


def strptime_day(value):
    try:
        return datetime.strptime(value.strip(), "%Y-%m-%d").date()
    except (ValueError, AttributeError):
        return None


def test_parse_day_equals_strptime(spark):
    values = ["2024-01-05", "2024-1-5", " 2024-02-29\n", "2023-02-29", "2024-02-30", "01/01/2024",
              "2024-01-05T00:00:00", "24-01-05", "12024-01-05", "2024-13-01", "2024-00-10", "", None,
              "0000-01-01", "0999-12-31", "2024-001-05", "2024-1-05x"]
    assert column(spark, values, dates.parse_day) == [strptime_day(v) for v in values]
    assert column(spark, ["2024-01-05 10:00:00", "2024-01-05", "x"], dates.lenient_iso_day) == [
        "2024-01-05", "2024-01-05", None]


def iso_shown(value):
    s = (value or "").strip()
    if not s:
        return None
    try:
        return datetime.fromisoformat(s).strftime("%Y-%m-%d %H:%M:%S")
    except ValueError:
        return s


def test_show_stamp_drops_the_offset(spark):
    values = ["2026-06-16T09:03:16.415174+00:00", "2026-06-16T09:03:16+02:00", "2026-06-16 23:59:59Z",
              "2026-06-16", "2026-02-30T01:00:00", "hier", " ", None, "2026-06-16T09:03",
              "2026-06-16T09:03:16-0530", "2026-06-16T25:00:00"]
    assert column(spark, values, dates.show_stamp) == [iso_shown(v) for v in values]


def test_measure_conventions(spark):
    row = spark.range(1).select(
        dates.measure_stamp(F.lit("2024-03-01").cast("date")).alias("ts"),
        dates.measure_uuid(F.lit("00000000001965")).alias("uuid"),
        dates.measure_format().alias("fmt")).head()
    assert (row.ts, row.uuid, row.fmt) == (datetime(2024, 2, 29), "enedis_CM_00000000001965", 1)


def test_boolean_dialects(spark):
    words = ["Vrai", " FAUX ", "true", "False", "1", "0", "yes", "No", "oui", "", None, "2", "0.0"]
    for dialect, (yes, no) in BOOLEAN_DIALECTS.items():
        if dialect == "existing":
            continue
        known = {**{w: True for w in yes}, **{w: False for w in no}}
        want = [known.get(w.strip().lower()) if w else None for w in words]
        assert column(spark, words, lambda c: booleans.parse_bool(c, dialect)) == want
    assert column(spark, words, lambda c: booleans.parse_bool(c, "existing")) == [
        True, False, True, False, True, False, False, False, False, False, False, True, False]
    assert column(spark, ["Yes", None, "oui"], lambda c: booleans.bool_text(c, F.lit("true"))) == [
        "true", "true", "true"]


def test_payload(spark):
    raw = ['{"code_statut_traitement": "2000000010"}', "Champ manquant : nom", "null", "NULL", " ", None,
           '["a"]']
    assert column(spark, raw, lambda c: F.to_json(payload.payload(c))) == [
        '{"code_statut_traitement":"2000000010"}', '"Champ manquant : nom"', None, None, None, None,
        '["a"]']
    assert column(spark, raw, lambda c: payload.payload_field(c, "code_statut_traitement"))[:2] == [
        "2000000010", None]
    built = spark.range(1).select(payload.build_error(F.lit("SGT1"), F.lit('dit "non"')).alias("j")).head().j
    assert built == '{"code_statut_traitement":"SGT1","message_retour_traitement":"dit \\"non\\""}'


def python_hex(value):
    try:
        return ipaddress.ip_address(value).packed.hex()
    except ValueError:
        return None


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(5)
    values = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::1:2", "1:2:3:4:5:6:7:8",
              "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":::", ":1::2", "1:", "12345::",
              "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.400", "fe80::1%eth0", "g::", "localhost", "",
              "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "::1.2.3.4:5", "A:B::C"]
    values += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(50)]
    for _ in range(100):
        bits = rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128)
        values.append(str(ipaddress.IPv6Address(bits)))
    assert column(spark, values, net.address_hex) == [python_hex(v) for v in values]


def test_last_hop(spark):
    headers = ["192.0.2.4, 198.51.100.1:49152", "192.0.2.1, 203.0.113.8:8080", "100.64.0.5:10", "[::1]:443", "::1",
               "1.2.3.4, ", None, ""]
    assert column(spark, headers, net.last_hop) == [
        "198.51.100.1", "203.0.113.8", "100.64.0.5", "::1", "::1", None, None, None]


def test_ranges_hold_the_addresses_of_their_networks(spark):
    rng = random.Random(8)
    for size in (1, 2, 3, 7, 8, 9, 200):
        networks = [ipaddress.ip_network((rng.getrandbits(12) << 20, rng.randint(8, 32)), strict=False)
                    for _ in range(size)] + [ipaddress.ip_network("2001:db8::/33")]
        ranges = net.parse_ranges(", zut,, ".join(map(str, networks)))
        assert ranges == sorted(ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        edges = [n.network_address + k for n in networks[:40] for k in (-1, 0, 1) if int(n.network_address)]
        edges += [n.broadcast_address + 1 for n in networks[:40] if int(n.broadcast_address) < 2**32 - 1]
        edges += [ipaddress.ip_address(x) for x in ("0.0.0.0", "255.255.255.255", "::", "2001:db8:7fff::", "ffff::")]
        got = spark.createDataFrame([(a.packed.hex(),) for a in edges] + [(None,)], "a string").select(
            net.in_ranges(net.address_key(F.col("a")), ranges).alias("in")).collect()
        assert [r[0] for r in got] == [any(a in n for n in networks) for a in edges] + [False]


def test_neighbouring_networks_are_one_range():
    assert net.parse_ranges("10.0.1.0/24, 10.0.0.0/24, 10.0.2.0/25, 10.0.1.7, 10.0.4.0/24") == [
        ("40a000000", "40a00027f"), ("40a000400", "40a0004ff")]


def test_typed_day(spark):
    assert spark.range(1).select(dates.iso_day(F.lit(date(2024, 1, 5))).alias("d")).head().d == "2024-01-05"
