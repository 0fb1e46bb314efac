import ipaddress
import random
import re
from datetime import date, datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from meterfold import fixed_values as fv
from meterfold.operators import access, consumption, registry, requests

NOW = datetime(2026, 6, 16, 9, 3, 16)
STAMP = "2026-06-16T09:03:16.000000+00:00"

PERIODS = [
    ("2023-12-01", "2024-01-01", 900.0), ("2024-01-01", "2024-02-01", 1234.5),
    ("2024-03-01", "2024-04-01", 1100.0), ("2024-05-01", "2024-06-01", 800.0),
    ("2024-05-01", "2024-07-01", 1500.0), ("2023-11-01", "2024-02-01", 2000.0),
    ("bientôt", "2024-02-01", 1.0), ("2024-01-01", None, 1.0), ("2024-1-5", "2024-01-09", float("nan")),
]


def gas_periods(spark):
    return spark.createDataFrame(
        [("GI1", a, b, "1M", v, " kWh " if v > 1000 else None) for a, b, v in PERIODS],
        "id_pce string, date_debut string, date_fin string, frequence string, consommation double, unite string")


def measures(spark):
    d = date(2024, 1, 1), date(2024, 2, 1)
    return spark.createDataFrame(
        [("00000000001965", "TURPE_HCB", 803.0, *d), ("00000000001965", "FRN_P", 120.0, *d),
         ("00000000001965", "TOTAL", 923.0, *d), ("00000000000002", "FRN_P", 1.0, *d)],
        "id_pdl string, label string, val double, date_debut date, date_fin date")


def ask(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "req_id int, provider string, sensor_id string, `from` string, `to` string")


def test_contained_periods(spark):
    asked = ask(spark, ("grdf", "GI1", "2024-01-01", "2024-06-01"), (" ENEDIS", "00000000001965", "2024-01-01", "2024-02-01"))
    found = consumption.requested_periods(asked, consumption.all_periods(gas_periods(spark), measures(spark)))
    rows = found.orderBy("req_id", "date_debut").collect()
    assert [(r.req_id, r.date_debut, r.consommation, r.unite) for r in rows] == [
        (0, "2024-01-01", 1234.5, "kWh"), (0, "2024-03-01", 1100.0, "kWh"), (0, "2024-05-01", 800.0, "kWh"),
        (0, "2024-1-5", None, "kWh"), (1, "2024-01-01", 923.0, "kWh")]


def test_request_outcomes(spark):
    ok = ("2024-01-01", "2024-06-01")
    asked = ask(
        spark, ("grdf", "GI1", *ok), ("enedis", "00000000001965", *ok), ("enedis", "00000000000002", *ok),
        ("enedis", "00000000000003", *ok), ("grdf", "GI1", "2025-01-01", "2025-02-01"), (None, "GI1", *ok),
        ("foobar", "GI1", *ok), ("grdf", " ", *ok), ("grdf", "GI1", "01/01/2024", "x"),
        ("grdf", "GI1", "2024-01-01", None), ("grdf", "GI1", "2024-06-01", "2024-01-01"), ("GRDF", "GI1", *ok))
    out = consumption.request_outcomes(
        asked, consumption.all_periods(gas_periods(spark), measures(spark)),
        consumption.known_sensors(gas_periods(spark), measures(spark))).orderBy("req_id").collect()
    assert [(r.http_status, r.champ, r.n_kept) for r in out] == [
        (200, None, 4), (200, None, 1), (200, None, 0), (404, None, None), (200, None, 0),
        (400, "provider", None), (400, "provider", None), (400, "sensor_id", None), (400, "from", None),
        (400, "to", None), (400, "to", None), (200, None, 4)]
    assert out[3].erreur == fv.SENSOR_NOT_FOUND


def test_counting_by_a_sweep_equals_the_model(spark):
    rng = random.Random(6)
    day = lambda: date(2020, 1, 1) + timedelta(rng.randint(0, 500))
    periods = []
    for i in range(2500):  # most rows are of one sensor; some bounds are missing or in the wrong order
        first = day()
        periods.append(("enedis", "hot" if i % 3 else f"s{rng.randint(0, 4)}", rng.choice([first] * 30 + [None]),
                        rng.choice([first + timedelta(rng.randint(-3, 40))] * 30 + [None])))
    windows = {("enedis", "hot" if i % 2 else f"s{rng.randint(0, 6)}", *sorted((day(), day() + timedelta(2)))) for i in range(400)}
    endless = [("enedis", s, date(1, 1, 1), date(9999, 12, 31)) for s in ("hot", "s1", "none")]
    windows |= {*endless, ("enedis", "s2", date(1, 1, 1), date(2020, 6, 1)), ("enedis", "s2", date(2020, 6, 1), date(9999, 12, 31))}
    asked = spark.createDataFrame(sorted(windows), "provider string, sensor_id string, low date, high date")
    stored = spark.createDataFrame(periods, "provider string, sensor_id string, first_day date, last_day date")
    got = {(r.sensor_id, r.low, r.high): r.n_kept for r in consumption.window_counts(asked, stored).collect()}
    counts = {(s, a, b): sum(1 for _, t, f, e in periods if t == s and f and e and a <= f and e <= b) for _, s, a, b in windows}
    assert got == {w: n for w, n in counts.items() if n} and len(got) > 300
    # A window without end is one node; the others are as many as their length has bits.
    nodes = consumption._window_nodes(asked).groupBy("sensor_id", "low", "high").count().collect()
    assert all(r["count"] == 1 for r in nodes if r.high == date(9999, 12, 31)) and max(r["count"] for r in nodes) <= 22
    # Windows meet periods only at the nodes: every join is on one row per sensor, or on whole nodes.
    rows = consumption._node_counts(consumption._in_reach(stored, asked)).count()
    assert rows <= len(periods) * 23 < len(periods) * len(windows) / 2


def test_a_period_is_counted_at_the_levels_of_its_windows_only(spark):
    days = [date(2020, 1, 1) + timedelta(k) for k in range(300)]
    stored = spark.createDataFrame([("grdf", s, d, d + timedelta(9)) for s in ("one", "two") for d in days],
                                   "provider string, sensor_id string, first_day date, last_day date")
    last = days[-1] + timedelta(9)
    asked = spark.createDataFrame(
        [("grdf", "one", days[0], last), ("grdf", "two", days[0], last), ("grdf", "two", days[0], days[0] + timedelta(63))],
        "provider string, sensor_id string, low date, high date")
    rows = consumption._node_counts(consumption._in_reach(stored, asked)).groupBy("sensor_id").count().collect()
    # A window up to the last asked day is one node, and so are 64 days: one row per period and node.
    assert {r.sensor_id: r["count"] for r in rows} == {"one": 300, "two": 600}
    got = {(r.sensor_id, r.high): r.n_kept for r in consumption.window_counts(asked, stored).collect()}
    assert got == {("one", last): 300, ("two", last): 300, ("two", days[0] + timedelta(63)): 55}


def test_requests_are_checked_once(spark):
    asked = ask(spark, ("grdf", "GI1", "2024-01-01", "2024-06-01"), ("GRDF", "GI1", "x", None)).withColumn(
        "to", F.concat(F.col("to"), F.lit("")))
    out = consumption.request_outcomes(
        asked, consumption.all_periods(gas_periods(spark), measures(spark)),
        consumption.known_sensors(gas_periods(spark), measures(spark)))
    # What the answer reads of the requests is the checked table, not the texts.
    assert "concat(to" not in plan_of(out) and [r.http_status for r in out.orderBy("req_id").collect()] == [200, 400]


def test_a_window_without_end_reads_stored_years_only(spark):
    asked = ask(spark, ("grdf", "GI1", "0001-01-01", "9999-12-31"))
    found = consumption.requested_periods(asked, consumption.all_periods(gas_periods(spark), measures(spark)))
    assert found.count() > 3 and "sequence" not in plan_of(found)


def test_one_provider_prunes_the_other(spark):
    both = consumption.all_periods(gas_periods(spark), measures(spark)).where("provider = 'enedis'")
    assert plan_of(both).count("Scan") == 1


# --- registry ------------------------------------------------------------------------------

def rights(spark, n, state="Active"):
    return spark.createDataFrame([(f"PCE{i:02d}", state, None) for i in range(n)],
                                 "id_pce string, etat_droit_acces string, dernier_appel_techniques string")


def test_six_operators(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    kept = {op: [r.v for r in registry.filter_by(df, "v", op, "a").collect()]
            for op in ("=", "!=", "<", ">", "<=", ">=")}
    assert kept == {"=": ["a"], "!=": ["b", None], "<": [], ">": ["b"], "<=": ["a"], ">=": ["a", "b"]}
    with pytest.raises(ValueError):
        registry.filter_by(df, "v", "LIKE", "a")


def test_paging(spark):
    df = rights(spark, 10).withColumns({c: F.lit(None).cast("string") for c in (
        "partner", "platform_code", "date_debut_droit_acces", "date_fin_droit_acces", "date_creation",
        "derniere_maj", "message_erreur_declare", *fv.GAS_PERIMETERS)})
    page = registry.gas_page(df, registry.page_request(spark, limit="3", offset="6"))
    assert [(r.id_pce, r.total) for r in page.collect()] == [("PCE06", 10), ("PCE07", 10), ("PCE08", 10)]
    assert len(page.columns) == 12 and len(registry.gas_view(df).columns) == 13
    assert [r.id_pce for r in registry.page_after(df, "id_pce", "PCE07", 5).collect()] == ["PCE08", "PCE09"]
    assert registry.gas_view(df.withColumn("etat_droit_acces", F.lit(" "))).head().statut == "nouveau"
    assert registry.gas_listing(df, "nouveau").count() == 0


@pytest.mark.parametrize("offset", [0, 3, 41, 90, 118, 119, 500])
def test_deep_page_equals_the_sorted_slice(spark, offset):
    ids = [f"{(i * 37) % 101:014d}" for i in range(101)] + [None] * 12 + ["00000000000040"] * 6
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id_pdl string, n int").repartition(5)
    wanted = registry.page_request(spark, limit="9", offset=str(offset))
    got = registry.deep_page(df, registry.elec_place(), wanted)
    ordered = sorted(ids, key=lambda i: (i is None, i or ""))
    rows = got.collect()
    assert got.columns == df.columns
    assert [r.id_pdl for r in rows] == ordered[offset:offset + 9]
    assert len({r.n for r in rows}) == len(rows) and all(ids[r.n] == r.id_pdl for r in rows)


def test_only_deep_pages_are_located_by_counts(spark, monkeypatch):
    df = spark.range(50).selectExpr("lpad(cast(id AS string), 4, '0') AS id_pce")
    plans = []
    for top in (10, 1000):
        monkeypatch.setattr(registry, "TOP_ROWS", top)
        out = registry.page(df, registry.gas_place(), registry.page_request(spark, limit="4", offset="30"))
        assert [r.id_pce for r in out.collect()] == ["0030", "0031", "0032", "0033"]
        plans.append(plan_of(out))
    assert "Offset" not in plans[0] and "TakeOrdered" not in plans[0] and "TakeOrdered" in plans[1]


@pytest.mark.parametrize("given,champ", [
    ({"limit": "0"}, "limit"), ({"limit": "500"}, "limit"), ({"limit": "abc"}, "limit"), ({"limit": "-3"}, "limit"),
    ({"offset": "-1"}, "offset"), ({"statut": "Cloturé"}, "statut")])
def test_refused_parameters(spark, given, champ):
    with pytest.raises(registry.InvalidParameter) as refused:
        registry.page_request(spark, **given)
    assert (refused.value.erreur, refused.value.champ) == (fv.INVALID_FIELD, champ)


def test_default_parameters(spark):
    checked = registry.page_request(spark, " ", "", None)
    assert (checked.statut, checked.limit, checked.offset) == (None, 50, 0)


def test_active_without(spark):
    df = spark.createDataFrame([("A", "Active", None), ("B", "Active", " "), ("C", "Active", "x"), ("D", "nouveau", None)],
                               "id_pce string, etat_droit_acces string, appel string")
    assert {r.id_pce for r in registry.active_without(df, "appel").collect()} == {"A", "B"}
    assert {r.id_pce for r in registry.active_without(df, "absent").collect()} == {"A", "B", "C"}
    assert registry.in_state(df, "inconnu").count() == 0


def test_select_ids_and_existence(spark):
    df = rights(spark, 3)
    ids = spark.createDataFrame([("PCE01",), ("PCE01",), ("X",)], "id_pce string")
    assert [r.id_pce for r in registry.select_ids(df, ids, "id_pce").collect()] == ["PCE01"]
    assert sorted(r.known for r in registry.with_existence(ids, df, "id_pce").collect()) == [False, True, True]


def test_mark_collected(spark):
    calls = spark.createDataFrame(
        [("PCE00", "publiee", 200, 1), ("PCE00", "replay", 500, 2), ("NEW", "techniques", 404, 3)],
        "id_pce string, collection_type string, status_code int, call_ord int")
    out = {r.id_pce: r for r in registry.mark_collected(rights(spark, 2), calls, NOW).collect()}
    assert (out["PCE00"].derniere_collecte_publiee, out["PCE00"].derniere_replay_trimestrielle,
            out["PCE00"].dernier_appel_techniques, out["PCE00"].api_response_code) == (STAMP, STAMP, None, 500)
    assert out["PCE01"].derniere_maj is None and out["NEW"].dernier_appel_techniques == STAMP
    onboarded = registry.mark_onboarded(rights(spark, 1), calls, NOW).where("id_pce = 'PCE00'").head()
    assert (onboarded.date_onboard_history, onboarded.api_response_onboard_history) == (STAMP, 500)
    with pytest.raises(ValueError, match="collection_type invalide : autre"):
        registry.mark_collected(rights(spark, 1), calls.withColumn("collection_type", F.lit("autre")), NOW)


def test_status_and_errors(spark):
    pdl = spark.createDataFrame(
        [("A", "nouveau", None, None, "old", None), ("B", "nouveau", "true", "c", None, None)],
        "id_pdl string, statut string, statut_cdc string, commentaire string, erreur string, date_modification timestamp_ntz")
    updates = spark.createDataFrame([("A", "traite", None, "é" * 60)],
                                    "id_pdl string, statut string, statut_cdc string, commentaire string")
    out = {r.id_pdl: r for r in registry.update_status(pdl, updates, NOW).collect()}
    assert (out["A"].statut, out["A"].commentaire, out["A"].date_modification) == ("traite", "é" * 50, NOW)
    assert (out["B"].statut, out["B"].commentaire, out["B"].date_modification) == ("nouveau", "c", None)
    errors = spark.createDataFrame([("B", "SGT401", "l'erreur")], "id_pdl string, code string, message string")
    failed = registry.set_errors(pdl, errors, NOW)
    assert {r.id_pdl: r.erreur for r in failed.collect()} == {
        "A": "old", "B": '{"code_statut_traitement":"SGT401","message_retour_traitement":"l\'erreur"}'}
    cleared = registry.clear_errors(failed, F.col("id_pdl") == "B", NOW).where("id_pdl = 'B'").head()
    assert (cleared.erreur, cleared.date_modification) == (None, NOW)


def test_counts_and_collection(spark):
    pdl = spark.createDataFrame([("traite",), ("traite",), (None,), ("résilié",), ("revoque",)], "statut string")
    assert {r.statut: r.n for r in registry.count_by_status(pdl).collect()} == {
        "traite": 2, "None": 1, "résilié": 1, "revoque": 1}
    assert sorted(r.statut for r in registry.collected(pdl).collect()) == ["revoque", "traite", "traite"]


# --- requests ------------------------------------------------------------------------------

HISTORY = "id_pdl string, code_prestation string, datetime_requete timestamp_ntz, id_affaire string"


def test_recent_requests(spark):
    at = lambda days: NOW - timedelta(days=days)
    history = spark.createDataFrame(
        [("A", "R63", at(40), "1"), ("A", "R63", at(30), "2"), ("A", "R63", at(5), "3"), ("B", "R63", at(31), "4"),
         ("C", "R63", None, "5"), ("A", "R64", at(1), "6")], HISTORY)
    asked = spark.createDataFrame([("A", "R63"), ("B", "R63"), ("C", "R63"), ("D", "R63")],
                                  "id_pdl string, code_prestation string")
    found = {r.id_pdl: r.id_affaire for r in requests.recent_requests(asked, history, NOW).collect()}
    assert found == {"A": "3", "B": None, "C": None, "D": None}
    assert {r.id_pdl for r in requests.not_recent(asked, history, NOW).collect()} == {"B", "C", "D"}


def spaced(rows, accepted, days):
    """Refused if one was accepted in the ``days`` days before, whatever was accepted after."""
    times, kept = {}, []
    for k, c, t, _ in accepted:
        times.setdefault((k, c), []).append(t)
    for k, c, t, a in sorted(rows, key=lambda r: (r[2], r[3])):
        held = times.setdefault((k, c), [])
        if not any(t - timedelta(days=days) <= x <= t for x in held):
            held.append(t)
            kept.append(a)
    return sorted(kept)


def test_accept_spaced_equals_the_model(spark):
    rng = random.Random(3)
    moment = lambda lo, hi: NOW + timedelta(hours=rng.randint(lo * 24, hi * 24))
    rows = [(rng.choice("AAAAB"), rng.choice(["x", "y"]), moment(0, 40), f"{i:03d}") for i in range(150)]
    before = [("A", "x", moment(-9, 2), "old1"), ("A", "x", moment(-30, -8), "old2"), ("Z", "x", NOW, "old3")]
    got = requests.accept_spaced(spark.createDataFrame(rows, HISTORY), spark.createDataFrame(before, HISTORY), 7)
    assert sorted(r.id_affaire for r in got.collect()) == spaced(rows, before, 7)


def test_accept_spaced_takes_rounds_by_the_logarithm_of_the_chain(spark, monkeypatch):
    rng = random.Random(4)
    hours = rng.sample(range(3 * 365 * 24), 3000)  # three years of one pair
    rows = [("HOT", "x", NOW + timedelta(hours=h), f"{k:05d}") for k, h in enumerate(hours)] + [
        ("HOT", "x", NOW + timedelta(hours=hours[0]), "00000b"), ("B", "x", NOW, "b"), (None, "x", NOW, "c")]
    asked = spark.createDataFrame(rows, HISTORY)
    made, checkpoint = [], type(asked).checkpoint
    monkeypatch.setattr(type(asked), "checkpoint", lambda self, *a, **k: made.append(1) or checkpoint(self, *a, **k))
    got = requests.accept_spaced(asked, asked.limit(0), 7)
    kept = spaced(rows, [], 7)
    assert sorted(r.id_affaire for r in got.collect()) == kept and len(kept) > 140
    # 2 for each of the 8 doublings of a chain of some 150 links, and a few before and at the end.
    assert len(made) <= 2 * 8 + 7


# --- access --------------------------------------------------------------------------------

def test_access_audit_equals_the_standard_library(spark):
    rng = random.Random(9)
    nets = ["10.0.0.0/9", "192.168.1.77/32", "8.8.8.8", "172.16.0.0/13", "2001:db8::/33", "::1", "1.2.3.4/30", "zut"]
    hosts = [str(ipaddress.ip_address(rng.choice([10, 172, 192]) << 24 | rng.getrandbits(24))) for _ in range(200)]
    hosts += ["8.8.8.8", "192.168.1.77", "1.2.3.7", "1.2.3.8", "::1", "::2", "2001:db8:7fff::1", "2001:db8:8000::1", "x"]
    log = spark.createDataFrame(
        [(i, f"9.9.9.9, {'[' + h + ']' if ':' in h else h}:443") for i, h in enumerate(hosts)] + [(-1, None)],
        "i int, x_forwarded_for string")
    networks = [ipaddress.ip_network(n, strict=False) for n in nets[:-1]]

    def inside(host):
        try:
            return any(ipaddress.ip_address(host) in n for n in networks)
        except ValueError:
            return False

    want = {i: inside(h) for i, h in enumerate(hosts)} | {-1: False}
    setting = ", ".join(nets)
    assert {r.i: r.allowed for r in access.audit_access(log, setting).collect()} == want
    long = setting + "".join(f", 11.{i // 250}.{i % 250}.0/24" for i in range(3000))
    audited = access.audit_access(log, long)
    assert {r.i: r.allowed for r in audited.collect()} == want
    assert not re.search("Join|Exchange", plan_of(audited))
    refused = access.refusals(access.audit_access(log, setting))
    assert refused.count() == list(want.values()).count(False)
    assert refused.head().erreur == "IP_NON_AUTORISEE"


def test_empty_allowlist(spark):
    log = spark.createDataFrame([("1.2.3.4",)], "x_forwarded_for string")
    assert access.audit_access(log, " , ").head().allowed is True
    assert access.audit_access(log, "", allow_all_when_unset=False).head().allowed is False


def test_blocking_holds_no_whole_pair_in_a_window(spark):
    rng = random.Random(12)
    rows = [("P1" if k % 2 else f"P{k % 5}", "A", NOW + timedelta(hours=rng.randrange(3000)), k) for k in range(1200)]
    rows += [(None, "A", NOW, 5000), ("P1", None, NOW, 5001)]
    before = [("P1" if k % 2 else f"P{k % 5}", "A", NOW + timedelta(hours=rng.randrange(3000)), 9000 + k) for k in range(20)]
    asked, accepted = (spark.createDataFrame(
        [(p, c, t, str(k)) for p, c, t, k in x],
        "id_pdl string, code_prestation string, datetime_requete timestamp, id_affaire string") for x in (rows, before))
    requests.ensure_checkpoint_dir(spark)
    free = requests._blocked_before(asked, accepted, 7)
    want = sorted(str(k) for p, c, t, k in rows if not any(
        (p, c) == (q, d) and s <= t <= s + timedelta(days=7) for q, d, s, _ in before))
    assert sorted(r.id_affaire for r in free.collect()) == want and 0 < len(want) < len(rows)
    # Rows of a pair are sorted by time inside one sort task only.
    for line in plan_of(free).splitlines():
        if "windowspecdefinition" in line and "datetime_requete" in line.split("windowspecdefinition")[1]:
            assert "_part" in line.split("windowspecdefinition")[1].split("datetime_requete")[0]
