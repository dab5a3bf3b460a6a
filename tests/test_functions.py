"""Scalar expressions against the known vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions import contract, fingerprint, identity, owner, states, time
from opslake.operators.catalog import with_ownership

MONDAY = (
    "Executed as user: svc_etl. Could not find file 'C:\\landing\\BCBS_ELIG_20260901.csv' at 2026-09-01 03:15:22. "
    "[SQLSTATE 42000] (Error 4860).  The step failed."
)
TUESDAY = MONDAY.replace("20260901", "20260902").replace("2026-09-01 03:15:22", "2026-09-02 03:14:58")
LOGIN = "Executed as user: svc_etl. Login failed for user 'carrier_ro'. [SQLSTATE 28000] (Error 18456).  The step failed."


@pytest.mark.parametrize(
    ("date", "clock", "zone", "expected"),
    [
        (20260903, 140509, "UTC", dt.datetime(2026, 9, 3, 14, 5, 9)),
        (20260903, 140509, "America/Chicago", dt.datetime(2026, 9, 3, 19, 5, 9)),
        (20260115, 140000, "America/Chicago", dt.datetime(2026, 1, 15, 20, 0)),
        (20260904, 0, "UTC", dt.datetime(2026, 9, 4)),
        (0, 0, "UTC", None),
        (20261399, 0, "UTC", None),
        (20260308, 23000, "America/Chicago", dt.datetime(2026, 3, 8, 8, 30)),
        (20261101, 13000, "America/Chicago", dt.datetime(2026, 11, 1, 7, 30)),
        (20261101, 3000, "America/Chicago", dt.datetime(2026, 11, 1, 5, 30)),
        (20261101, 23000, "America/Chicago", dt.datetime(2026, 11, 1, 8, 30)),
        (20260405, 14500, "Australia/Lord_Howe", dt.datetime(2026, 4, 4, 15, 15)),
        (20260405, 11500, "Australia/Lord_Howe", dt.datetime(2026, 4, 4, 14, 15)),
        (20261025, 23000, "Europe/Berlin", dt.datetime(2026, 10, 25, 1, 30)),
    ],
)
def test_packed_time(one, date, clock, zone, expected):
    got = one(F.date_format(time.packed_to_utc(F.col("d"), F.col("t"), zone), "yyyy-MM-dd HH:mm:ss"), d=("int", date), t=("int", clock))
    assert got == (expected and expected.strftime("%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize(
    ("packed", "seconds"),
    [(0, 0), (-5, 0), (45, 45), (13045, 5445), (235959, 86399), (250000, 90000), (1234500, 123 * 3600 + 45 * 60)],
)
def test_duration(one, packed, seconds):
    assert one(time.packed_seconds(F.col("p")), p=("int", packed)) == seconds
    assert one(time.packed_interval(F.col("p")), p=("int", packed)) == dt.timedelta(seconds=seconds)


def test_execution_key_drops_fractions(one):
    key = time.execution_key(F.lit("0F8FAD5B-d9cb-469f-a165-70867728950e"), F.col("t").cast("timestamp"))
    assert one(key, t=("string", "2026-09-03 14:05:09.873")) == "0f8fad5b-d9cb-469f-a165-70867728950e:20260903140509"


@pytest.mark.parametrize(("text", "position"), [("42", 42), ("", 0), (None, 0), ("4x", 0), (" 7", 0), ("-3", 0), ("99999999999999999999", 0)])
def test_history_position(one, text, position):
    assert one(time.history_position(F.col("w")), w=("string", text)) == position


def test_poll_position_falls_back_to_lookback(one):
    poll = F.lit("2026-09-03 02:00:00").cast("timestamp")
    shown = lambda w: one(F.date_format(time.poll_position(F.col("w"), poll), "yyyy-MM-dd HH:mm"), w=("string", w))
    assert shown("2026-09-01T05:00:00.0000000+00:00") == "2026-09-01 05:00"
    assert shown(None) == shown("junk") == "2026-09-02 02:00"


@pytest.mark.parametrize(
    ("text", "name", "ticket"),
    [
        ("Owner: ETL Team; Ticket: DE-123", "ETL Team", False),
        ("owner = LPDE", "LPDE", False),
        ("team=carrier-integration", "carrier-integration", False),
        ("Team: Data Platform.", "Data Platform", False),
        ("Nightly BCBS load. Ticket: DE-4821", "DE-4821", True),
        ("Loads BCBS files #lpde nightly", "lpde", False),
        ("Page @data-eng on failure", "data-eng", False),
        ("Owner: ETL #nightly", "ETL", False),
        ("Ticket: DE-1 Owner: ETL", "ETL", False),
        ("Owner: ETL; runs nightly", "ETL", False),
        ("Owner: ETL\nRuns nightly", "ETL", False),
        ("Owner: data.platform", "data.platform", False),
        ("Owner: ETL Team. Loads BCBS.", "ETL Team", False),
        ("OWNER: Müller & Söhne, Bern", "Müller & Söhne", False),
    ],
)
def test_owner(one, text, name, ticket):
    got = one(owner.parse_owner(F.col("t")), t=("string", text))
    assert (got.owner, got.is_ticket) == (name, ticket)


@pytest.mark.parametrize(
    "text", [None, "", "   ", "No description available.", "See #4821 for details", "Steam: engine", "mail someone@example.com", "é@foo"]
)
def test_no_owner(one, text):
    assert one(owner.parse_owner(F.col("t")), t=("string", text)) is None


def test_matched_empty_owner_counts(one):
    assert one(owner.parse_owner(F.col("t")), t=("string", "Owner: ."))["owner"] == ""


def test_ownership_precedence(spark):
    rows = [
        (" Ops ", "Owner: ETL", ["#x"]), (None, "Owner: ETL", ["#x"]), (" ", "Ticket: DE-1", ["#x"]),
        (None, " no description AVAILABLE. ", ["plain", "team:etl", "#b"]), (None, "nothing", []), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "declared_owner string, description string, tags array<string>")
    got = [tuple(r) for r in with_ownership(df).select("team_id", "parsed_from", "raw_evidence").collect()]
    assert got == [
        ("Ops", "Owner", " Ops "), ("ETL", "Description", "Owner: ETL"), ("DE-1", "Ticket", "Ticket: DE-1"),
        ("etl", "Tags", "team:etl"), (None, "None", "nothing"), (None, "None", ""),
    ]


def test_fingerprints(one):
    shape = lambda x: one(fingerprint.shape(F.col("x")), x=("string", x))
    fp = lambda x: one(fingerprint.fingerprint(F.col("x")), x=("string", x))
    assert fp(MONDAY) == fp(TUESDAY) != fp(LOGIN)
    assert shape("Timeout after 30s at 2026-09-01 03:15:22 reading 'feed.csv' from Table1 handle 0x1F (code 7)") == (
        "TIMEOUT AFTER AT READING FROM TABLE1 HANDLE (CODE )"
    )
    assert fp("Could not   find\nstored procedure") == fp("could not find stored procedure")
    assert len(fp(MONDAY)) == 32 and fp(MONDAY) == fp(MONDAY).upper()
    assert shape("Große \u00df 12") == "GROßE ß"
    assert shape("Straße \ufb01x é") == "STRAßE \ufb01X É"


def test_upper_changes_one_character_into_one(spark):
    import re

    many = [c for c in map(chr, range(0x80, 0xFFFF)) if len(c.upper()) > 1]
    assert set(many) == set(fingerprint._MANY) and all(re.match(fingerprint._RARE, c) for c in many if c != "ß")
    rows = spark.createDataFrame([(f"aé{c}z",) for c in many], "t string")
    got = [r[0] for r in rows.select(fingerprint.simple_upper(F.col("t"))).collect()]
    assert got == [f"AÉ{c.title() if len(c.title()) == 1 else c}Z" for c in many]


def test_fingerprint_only_for_failures_with_text(spark):
    df = spark.createDataFrame([("Failed", "x"), ("Failed", " "), ("Failed", None), ("Succeeded", "x")], "s string, e string")
    got = [r[0] is None for r in df.select(fingerprint.failure_fingerprint(F.col("s"), F.col("e"))).collect()]
    assert got == [False, True, True, True]


def test_dedup_key(one):
    key = lambda *p: one(fingerprint.dedup_key(*[F.lit(x) for x in p]))
    assert len(key("CollectorZeroRows", "7")) == 64
    assert key("CollectorZeroRows", "7") != key("7", "CollectorZeroRows")
    assert key("a", None, "b") != key("a", "b")


def test_states(spark):
    codes = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 4, 99)], "c int").select(states.agent_status(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["Failed", "Succeeded", "Retry", "Cancelled", "Running", "Unknown"]
    names = ["success", "failed", "running", "queued", "up_for_retry", None, "SUCCESS"]
    got = spark.createDataFrame([(n,) for n in names], "c string").select(states.dag_state(F.col("c")))
    assert [r[0] for r in got.collect()] == ["Succeeded", "Failed", "Running", "Queued", "Unknown", "Unknown", "Unknown"]
    every = [vocab.QUEUED, vocab.RUNNING, vocab.SUCCEEDED, vocab.FAILED, vocab.CANCELLED, vocab.RETRY, vocab.UNKNOWN]
    got = spark.createDataFrame([(n,) for n in every], "c string").select(states.is_terminal(F.col("c")))
    assert [r[0] for r in got.collect()] == [False, False, True, True, True, False, False]


def test_dag_failure_text(one):
    text = lambda kind, note: one(
        states.describe_dag_failure(F.lit("d"), F.lit(kind), F.lit(note))
    )
    assert text("manual", None) == "Airflow DAG d run failed (manual)"
    assert text(None, "disk full") == "Airflow DAG d run failed (unknown trigger): disk full"
    assert text(None, "  ") == "Airflow DAG d run failed (unknown trigger)"


def test_canonical_ids_are_stable_and_sorted_by_time(one):
    mint = lambda native, at: one(identity.canonical_job_id(F.lit(1), F.lit(native), F.lit(at).cast("timestamp")))
    a = mint("Job-A", "2026-09-03 02:00:00")
    assert len(a) == 26 and a == mint("job-a", "2026-09-03 02:00:00") != mint("job-b", "2026-09-03 02:00:00")
    assert a[:10] < mint("job-a", "2026-09-03 02:00:01")[:10]
    assert set(a) <= set("0123456789ABCDEFGHJKMNPQRSTVWXYZ")


@pytest.mark.parametrize(
    ("text", "seconds"), [("02:00", 7200), ("06:30:15", 23415), ("24:00", None), ("2:00", None), ("720", None), (None, None)]
)
def test_clock(one, text, seconds):
    assert one(contract.clock_seconds(F.col("t")), t=("string", text)) == seconds


@pytest.mark.parametrize(
    ("value", "kind", "wrong"),
    [
        ("2026-09-01", "date", False), ("2026", "date", True), ("2026-13-01", "date", True), ("NOT_A_DATE", "date", True),
        ("1.50", "decimal", False), ("NOT_A_DECIMAL", "decimal", True), ("12", "int", False), ("1.5", "int", True),
        (None, "date", False), ("anything", "string", False), ("x", "uuid", False),
    ],
)
def test_wrong_type(one, value, kind, wrong):
    assert one(contract.wrong_type(F.col("v"), F.lit(kind)), v=("string", value)) is wrong


def test_fit_and_widths(one):
    assert one(contract.fit(F.lit("abcdef"), 4)) == "abcd"
    assert one(contract.fit(F.lit("ab"), 4)) == "ab  "
    assert one(contract.fit(F.lit(None).cast("string"), 2)) == "  "
    width = lambda k, n: one(contract.field_width(F.lit(k), F.lit(n).cast("int")))
    assert [width("date", 5), width("decimal", None), width("int", None), width("string", 7), width("string", None)] == [10, 12, 10, 7, 20]
