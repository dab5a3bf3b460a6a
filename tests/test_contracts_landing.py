"""Contract files, versions, and a landing zone with one defect of every kind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslake import vocab
from opslake.operators import contracts, scan, validate
from opslake.plans import contract_sync, landing, quarantine
from opslake.sources import contracts as files
from opslake.sources import landing as zone
from opslake.store import Store

YAML = """feedId: {feed}
owner: {owner}
landingPrefix: landing/{dir}/
fileMask: {mask}
arrivalWindow:
  start: {start}
  end: "06:00"
schema:
  name: S_v1
  columns:
    - name: MemberId
      type: string
      nullable: false
      maxLength: 8
    - name: EffectiveDate
      type: date
      nullable: false
    - name: Amount
      type: decimal
      nullable: true
    - name: Grp
      type: string
      nullable: true
      maxLength: 4
"""


def yaml(feed="A-ELIG", owner="ETL", dir="a", mask="A_ELIG_{yyyyMMdd}.csv", start='"02:00"'):
    return YAML.format(feed=feed, owner=owner, dir=dir, mask=mask, start=start)


def put(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)


def specs(spark, path):
    return {r.path.rsplit("/", 1)[1]: r for r in contracts.with_hash(contracts.check_rules(files.read(spark, str(path)))).collect()}


def test_contract_files(spark, tmp_path):
    reordered = "fileMask: A_ELIG_{yyyyMMdd}.csv\nextra: 1\n" + yaml().replace("fileMask: A_ELIG_{yyyyMMdd}.csv\n", "")
    texts = {
        "good.yaml": yaml(), "reordered.yml": reordered, "unquoted.yaml": yaml(start="02:00"), "owner.yaml": yaml(owner="Claims"),
        "noowner.yaml": "feedId: X\n", "window.yaml": yaml(start='"07:00"'), "broken.yaml": "feedId: [", "empty.yaml": "",
        "nocolumns.yaml": yaml().split("  columns")[0] + "  columns: []\n", "badtime.yaml": yaml(start='"25:00"'), "list.yaml": "- a\n",
        "noname.yaml": yaml().replace("name: Amount", "name: "), "notype.yaml": yaml().replace("type: decimal", "type: ' '"),
    }
    for name, text in texts.items():
        put(tmp_path / "sub", name, text)
    got = specs(spark, tmp_path)
    assert got["good.yaml"].error is None and got["good.yaml"].window_start == 7200 and got["good.yaml"].window_end == 21600
    assert [tuple(c) for c in got["good.yaml"].columns][:2] == [("MemberId", "string", False, 8), ("EffectiveDate", "date", False, None)]
    assert len(got["good.yaml"].spec_hash) == 64
    assert got["good.yaml"].spec_hash == got["reordered.yml"].spec_hash == got["unquoted.yaml"].spec_hash != got["owner.yaml"].spec_hash
    assert got["noowner.yaml"].error == "feed 'X': owner is required"
    assert got["window.yaml"].error == "feed 'A-ELIG': arrival window start must be before end"
    assert got["nocolumns.yaml"].error == "feed 'A-ELIG': schema must declare at least one column"
    assert got["noname.yaml"].error == "feed 'A-ELIG': a column is missing a name"
    assert got["notype.yaml"].error == "feed 'A-ELIG': column 'Amount' is missing a type"
    assert got["empty.yaml"].error == "contract is empty"
    for name in ("broken.yaml", "badtime.yaml", "list.yaml"):
        assert got[name].error.startswith("contract is not valid YAML")


def results(df):
    return {r.feed_id: (r.created, r.version, r.error is None) for r in df.collect()}


def test_sync(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "store")), tmp_path / "c"
    put(path, "good.yaml", yaml())
    put(path, "bad.yaml", "feedId: BROKEN\n")
    assert results(contract_sync.sync(store, str(path), 1, "2026-09-03 00:00:00")) == {"A-ELIG": (True, 1, True), "bad": (False, 0, False)}
    assert results(contract_sync.sync(store, str(path), 2, "2026-09-04 00:00:00"))["A-ELIG"] == (False, 1, True)
    put(path, "good.yaml", yaml(owner="Claims"))
    assert results(contract_sync.sync(store, str(path), 3, "2026-09-05 00:00:00"))["A-ELIG"] == (True, 2, True)
    assert [tuple(r) for r in store.current("feed").collect()] == [("A-ELIG", "Claims", "landing/a/", True)]
    versions = store.current("contract_version").orderBy("version").collect()
    assert [(r.version, r.effective_from.day) for r in versions] == [(1, 3), (2, 5)]
    contract_sync.sync(store, str(path), 3, "2026-09-05 00:00:00")
    assert store.current("contract_version").count() == 2


def test_versions_flip_within_and_across_batches(spark):
    rows = [("f", n, h) for n, h in enumerate("AABA")]
    df = spark.createDataFrame(rows, "feed_id string, place int, spec_hash string")
    none = spark.createDataFrame([], "feed_id string, version bigint, spec_hash string")
    number = lambda d, v: [(r.created, r.version) for r in contracts.next_versions(d, v, ["place"], scan.id_chunk("place", 2)).orderBy("place").collect()]
    assert number(df, none) == [(True, 1), (False, 1), (True, 2), (True, 3)]
    stored = spark.createDataFrame([("f", 4, "X"), ("f", 5, "A")], none.schema)
    assert number(df, stored) == [(False, 5), (False, 5), (True, 6), (True, 7)]


def names(spark, name, mask):
    feeds = spark.createDataFrame([("F", "in/", mask)], "feed_name string, landing_prefix string, file_mask string")
    came = spark.createDataFrame([("1", f"in/{name}")], "arrival_id string, key string")
    return validate.attribute(came, feeds).first().name_fit


@pytest.mark.parametrize(
    ("name", "fit"),
    [
        ("A1_20260903.csv", "exact"), ("A1_2026-09-03.csv", "date_format"), ("a1_20260903.csv", "case"), ("a1_2026-09-03.csv", "case_and_date"),
        ("A1_2026093.csv", None), ("A1_20260903.csv.bak", None), ("XA1_20260903.csv", None), ("A1_20260903.CSV", "case"), ("A1_.csv", None),
    ],
)
def test_names(spark, name, fit):
    assert names(spark, name, "A1_{yyyyMMdd}.csv") == fit


def test_undated_mask(spark):
    assert [names(spark, n, "MEMBERS.csv") for n in ("MEMBERS.csv", "members.csv", "MEMBERS2.csv")] == ["exact", "case", None]


def test_many_masks_below_one_prefix(spark):
    feeds = spark.range(3000).select(
        F.concat(F.lit("F"), "id").alias("feed_name"), F.lit("in/").alias("landing_prefix"),
        F.concat(F.lit("F"), F.col("id") % 1500, F.lit("_{yyyyMMdd}.csv")).alias("file_mask"),
    )
    came = spark.range(2000).select("id", F.col("id").alias("arrival_id"), F.concat(F.lit("in/f"), F.col("id"), F.lit("_20260903.csv")).alias("key"))
    got = validate.attribute(came, feeds)
    counts = got.groupBy("name_fit").count().collect()
    assert {r.name_fit: r["count"] for r in counts} == {"case": 1500, None: 500}
    wrong = got.filter("name_fit is not null").filter(F.col("feed_name") != F.greatest(F.concat(F.lit("F"), "id"), F.concat(F.lit("F"), F.col("id") + 1500)))
    assert wrong.isEmpty()


def test_digits_next_to_the_date(spark):
    feeds = spark.createDataFrame([("F", "in/", "A1{yyyyMMdd}9.csv")], "feed_name string, landing_prefix string, file_mask string")
    keys = ["in/A1202609039.csv", "in/A12026-09-039.csv", "out/A1202609039.csv", "in/zzz"]
    came = spark.createDataFrame([(str(n), k) for n, k in enumerate(keys, 1)], "arrival_id string, key string")
    got = {r.arrival_id: (r.feed_name, r.name_fit) for r in validate.attribute(came, feeds).collect()}
    assert got == {"1": ("F", "exact"), "2": ("F", "date_format"), "3": (None, None), "4": ("F", None)}


def test_longer_prefix_wins(spark):
    feeds = spark.createDataFrame([("short", "in/", "A_{yyyyMMdd}.csv"), ("long", "in/a/", "A_{yyyyMMdd}.csv"), ("other", "in/a/", "B_{yyyyMMdd}.csv")],
                                  "feed_name string, landing_prefix string, file_mask string")
    came = spark.createDataFrame([("1", "in/a/A_20260903.csv"), ("2", "in/A_20260903.csv"), ("3", "in/a/b_20260903.csv")], "arrival_id string, key string")
    got = {r.arrival_id: (r.feed_name, r.name_fit) for r in validate.attribute(came, feeds).collect()}
    assert got == {"1": ("long", "exact"), "2": ("short", "exact"), "3": ("other", "case")}


def test_version_in_force_equals_brute_force(spark):
    import random

    r = random.Random(9)
    t0 = dt.datetime(2026, 1, 1)
    versions = [(f, v, t0 + dt.timedelta(hours=v * r.randrange(5, 9))) for f in "abc" for v in range(1, 30)]
    came = [(r.choice("aaabx"), n, t0 + dt.timedelta(minutes=r.randrange(20000))) for n in range(400)]
    got = contracts.version_in_force(
        spark.createDataFrame(came, "feed_id string, arrival_id bigint, arrived_at timestamp"),
        spark.createDataFrame(versions, "feed_id string, version bigint, effective_from timestamp"), chunk_seconds=7200,
    )
    want = {}
    for f, n, at in came:
        known = [(e, v) for g, v, e in versions if g == f and e <= at]
        want[n] = max(known)[1] if known else None
    assert {x.arrival_id: x.version for x in got.collect()} == want


HEAD = "MemberId,EffectiveDate,Amount,Grp"
CLEAN = ["M1,2026-09-01,1.50,G1", "M2,2026-09-02,,", "M3,2026-09-03,2,\"G,3\""]
WIDTHS = [("MemberId", 8), ("EffectiveDate", 10), ("Amount", 12), ("Grp", 4)]


def csv(head=HEAD, rows=CLEAN):
    return "\n".join([head, *rows]) + "\n"


def fixed(columns=WIDTHS, rows=(("M1", "2026-09-01", "1.5", "G1"), ("M2", "2026-09-02", "", ""))):
    fit = lambda v, w: v[:w].ljust(w)
    lines = ["".join(fit(n, w) for n, w in columns)] + ["".join(fit(v, w) for v, (_, w) in zip(r, columns, strict=True)) for r in rows]
    return "\r\n".join(lines) + "\r\n"


FILES = {
    "clean": ("csv", csv()),
    "renamed": ("csv", csv("MemberId,Effective_Date,Amount,Grp")),
    "added": ("csv", csv(HEAD + ",Unexpected_Column_7", [r + ",UNEXPECTED" for r in CLEAN])),
    "removed": ("csv", csv("MemberId,EffectiveDate,Grp", ["M1,2026-09-01,G1", "M2,2026-09-02,"])),
    "nulls": ("csv", csv(rows=[",2026-09-01,1,G1", "M2,,1,G1", ",2026-09-02,1,G1"])),
    "types": ("csv", csv(rows=["M1,NOT_A_DATE,1,G1", "M2,2026-09-02,NOT_A_DECIMAL,G1"])),
    "long": ("csv", csv(rows=["XXXXXXXXXXXXXXX,2026-09-01,1,G1", "M2,2026-09-02,1,G1"])),
    "dupes": ("csv", csv(rows=[CLEAN[0], CLEAN[1], CLEAN[0], CLEAN[0], CLEAN[1]])),
    "fclean": ("txt", fixed()),
    "frenamed": ("txt", fixed([("MemberId", 8), ("Effective_Date", 10), ("Amount", 12), ("Group", 4)])),
    "fremoved": ("txt", fixed([("MemberId", 8), ("EffectiveDate", 10), ("Grp", 4)], [("M1", "2026-09-01", "G1")])),
    "fadded": ("txt", fixed([*WIDTHS, ("Unexpected_Column_12", 20)], [("M1", "2026-09-01", "1", "G1", "UNEXPECTED")])),
    "fnulls": ("txt", fixed(rows=[("", "2026-09-01", "1", "G1"), ("M2", "NOT_A_DATE", "1", "G1")])),
    "fblank": ("txt", fixed(rows=[("M1", "2026-09-01", "1", "G1"), ("", "", "", "")])),
    "fheader": ("txt", fixed(rows=[("MemberId", "2026-09-01", "1", "G1")])),
    "empty": ("csv", csv(rows=[])),
    "dat": ("dat", csv(rows=[",2026-09-01,1,G1"])),
    "bare": ("csv", ""),
    "fbare": ("txt", ""),
}
_ALL_GONE = {(vocab.V_REMOVED, c, 1) for c in HEAD.split(",")}
EXPECTED = {
    "clean": set(),
    "renamed": {(vocab.V_RENAMED, "EffectiveDate", 1)},
    "added": {(vocab.V_ADDED, "Unexpected_Column_7", 1)},
    "removed": {(vocab.V_REMOVED, "Amount", 1)},
    "nulls": {(vocab.V_NULL, "MemberId", 2), (vocab.V_NULL, "EffectiveDate", 1)},
    "types": {(vocab.V_TYPE, "EffectiveDate", 1), (vocab.V_TYPE, "Amount", 1)},
    "long": {(vocab.V_LENGTH, "MemberId", 1)},
    "dupes": {(vocab.V_DUPLICATE, "", 3)},
    "fclean": set(),
    "frenamed": {(vocab.V_RENAMED, "EffectiveD", 1), (vocab.V_RENAMED, "Grp", 1)},
    "fremoved": {(vocab.V_REMOVED, "Amount", 1)},
    "fadded": {(vocab.V_ADDED, "Unexpected_Column_12", 1)},
    "fnulls": {(vocab.V_NULL, "MemberId", 1), (vocab.V_TYPE, "EffectiveDate", 1)},
    "fblank": {(vocab.V_NULL, "MemberId", 1), (vocab.V_NULL, "EffectiveDate", 1)},
    "fheader": set(),
    "empty": set(),
    "dat": {(vocab.V_NULL, "MemberId", 1)},
    "bare": _ALL_GONE,
    "fbare": {(vocab.V_REMOVED, c, 1) for c in ("MemberId", "EffectiveD", "Amount", "Grp")},
}


@pytest.fixture(scope="module")
def verdict(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("zone")
    texts = base / "contracts"
    for name, (kind, content) in FILES.items():
        put(texts, f"{name}.yaml", yaml(name, dir=name, mask=f"{name.upper()}_{{yyyyMMdd}}.{kind}"))
        put(base / "landing" / name, f"{name.upper()}_20260903.{kind}", content)
    for name in ("gone", "drift", "late"):
        put(texts, f"{name}.yaml", yaml(name, dir=name, mask=f"{name.upper()}_{{yyyyMMdd}}.csv"))
    put(base / "landing" / "drift", "drift_2026-09-03.csv", csv())
    put(base / "landing" / "late", "LATE_20260903.csv.late", csv())
    good = contracts.check_rules(files.read(spark, str(texts))).filter("error is null").withColumn("version", F.lit(1).cast("bigint"))
    return landing.run(spark, str(base), good, "2026-09-03", "2026-09-03 23:00:00")


def test_landing_findings(verdict):
    got = {name: set() for name in FILES}
    for r in verdict.findings.collect():
        name = r.arrival_id.split("/")[-2]
        if name in got:
            got[name].add((r.check, r.column_name, r.occurrences))
    # Names of the same place are one rename, and a rename is told by its declared name.
    assert got == EXPECTED


def test_landing_verdicts(verdict):
    got = {r.feed_name: (r.result, r.name_fit) for r in verdict.arrivals.collect()}
    assert got["clean"] == ("Passed", "exact") and got["empty"][0] == "Passed"
    assert got["drift"] == ("Failed", "case_and_date")
    assert all(got[n][0] == ("Failed" if EXPECTED[n] else "Passed") for n in FILES)
    assert "late" not in got and "gone" not in got
    assert {r.feed_name for r in verdict.missing.collect()} == {"gone", "late"}


def test_landing_is_kept(spark, verdict, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        landing.keep(store, 1, "2026-09-03 23:00:00", verdict)
    kept = {r.feed_name: r.disposition for r in store.current("arrival").collect()}
    assert kept["clean"] in ("Validated", "Late") and kept["nulls"] == kept["drift"] == "Quarantined"
    results = {r.arrival_id.split("/")[-2]: r for r in store.current("validation").collect()}
    assert results["nulls"].result == "Failed" and [tuple(f) for f in results["nulls"].findings] == [
        (vocab.V_NULL, "EffectiveDate", 1), (vocab.V_NULL, "MemberId", 2)
    ]
    raised = {r.message: r.occurrences for r in store.current("alert").collect()}
    assert raised["gone: FeedLate"] == raised["late: FeedLate"] == raised["renamed: SchemaDrift"] == raised["bare: SchemaDrift"] == 1
    assert "nulls: SchemaDrift" not in raised


def test_offsets_and_cutting(spark):
    columns = spark.createDataFrame(
        [([("a", "date", True, None), ("b", "string", True, 3)],)], "columns array<struct<name:string,type:string,nullable:boolean,max_length:int>>"
    )
    got = columns.select(zone.with_offsets(F.col("columns")).alias("c")).select(zone.cut_fields(F.lit("2026-09-01XYZ"), F.col("c"))).first()[0]
    assert got == ["2026-09-01", "XYZ"]


def test_late_uses_the_window(spark):
    rows = [("x", dt.date(2026, 9, 3), 21600, dt.datetime(2026, 9, 3, 6, 0)), ("y", dt.date(2026, 9, 3), 21600, dt.datetime(2026, 9, 3, 6, 0, 1))]
    df = spark.createDataFrame(rows, "arrival_id string, day date, window_end int, arrived_at timestamp")
    assert [r.arrival_id for r in validate.late(df).collect()] == ["y"]


JSON = '{"MemberId": "M1", "EffectiveDate": "2026-09-01", "Amount": 1, "Grp": "G"}\n{"MemberId": "M2", "Extra": 1}\n{broken\n'


def test_each_file_is_judged_once_by_its_version(spark, tmp_path):
    import os

    texts, zone_dir = tmp_path / "contracts", tmp_path / "landing"
    for name, kind in (("a", "csv"), ("j", "json"), ("r", "csv")):
        put(texts, f"{name}.yaml", yaml(name, dir=name, mask=f"{name.upper()}_{{yyyyMMdd}}.{kind}"))
    first = contracts.check_rules(files.read(spark, str(texts))).filter("error is null").withColumn("version", F.lit(1).cast("bigint"))
    first = first.withColumn("effective_from", F.lit("2026-09-01").cast("timestamp"))
    # the second version of feed a has no Grp
    second = first.filter("feed_id = 'a'").withColumns({
        "version": F.lit(2).cast("bigint"), "effective_from": F.lit("2026-09-04 12:00:00").cast("timestamp"),
        "columns": F.filter("columns", lambda c: c["name"] != "Grp"),
    })
    specs = first.unionByName(second)
    store = Store(spark, str(tmp_path / "store"))

    def lands(path, content, at):
        put(zone_dir / path.split("/")[0], path.split("/")[1], content)
        stamp = dt.datetime.fromisoformat(at + "+00:00").timestamp()
        os.utime(zone_dir / path, (stamp, stamp))

    short = "MemberId,EffectiveDate,Amount"
    days = [("2026-09-03", csv()), ("2026-09-04", csv()), ("2026-09-05", csv(short, ["M1,2026-09-01,1.5"]))]
    for n, (day, content) in enumerate(days, 1):
        lands(f"a/A_{day.replace('-', '')}.csv", content, f"{day} 23:00:00" if n == 1 else f"{day} 01:00:00")
        if n == 2:
            lands("a/A_20260904_2.csv", csv(), "2026-09-04 02:00:00")
            lands("j/J_20260904.json", JSON, "2026-09-04 01:00:00")
            lands("r/R_20260904.csv", csv(rows=["M1,2026-09-01,2.5,G,surplus", "M1,2026-09-01,2.5,G,other", "M2,2026-09-02", 'M3,2026-09-03,1,"G,3"']), "2026-09-04 01:00:00")
        landing.judge(store, str(tmp_path), specs, day, f"{day} 23:30:00", n)
        landing.judge(store, str(tmp_path), specs, day, f"{day} 23:30:00", n)  # a replayed batch changes nothing
    rows = store.log("validation").collect()
    assert len(rows) == len({r.arrival_id for r in rows}) == 6
    by = {r.arrival_id.split("/")[-1]: (r.version, [tuple(f) for f in r.findings or []]) for r in rows}
    assert by["A_20260903.csv"] == (1, []) and by["A_20260904.csv"] == (1, []) and by["A_20260905.csv"] == (2, [])
    assert by["A_20260904_2.csv"] == (1, [("ExtraFile", "", 1)])
    assert by["R_20260904.csv"] == (1, [("RaggedRows", "", 3)])
    gone = [(vocab.V_REMOVED, c, 1) for c in ("Amount", "EffectiveDate", "Grp")]
    assert sorted(by["J_20260904.json"][1]) == sorted([*gone, (vocab.V_ADDED, "Extra", 1), ("unreadable", "", 1)])
    late = {r.message: r.occurrences for r in store.current("alert").collect() if r.type == vocab.FEED_LATE}
    assert late["a: FeedLate"] == 1 and late["j: FeedLate"] == 2  # missing on the first and the third day
    assert {r.routed_to for r in store.current("alert").collect()} == {None}


def test_a_missing_file_is_raised_once_and_goes_to_the_owner(spark, tmp_path):
    texts = tmp_path / "contracts"
    for name in "ab":
        put(texts, f"{name}.yaml", yaml(name, dir=name, mask=f"{name.upper()}_{{yyyyMMdd}}.csv"))
    (tmp_path / "landing").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    contract_sync.sync(store, str(texts), 1, "2026-09-01 00:00:00")
    owner = store.current("feed").filter("feed_name = 'a'").first().team_id
    specs = contracts.check_rules(files.read(spark, str(texts))).filter("error is null").withColumn("version", F.lit(1).cast("bigint"))
    late = lambda: {r.message: (r.occurrences, r.routed_to) for r in store.current("alert").collect()}
    runs = [("2026-09-03", "20:00:00"), ("2026-09-03", "21:00:00"), ("2026-09-03", "22:00:00"), ("2026-09-03", "22:00:00")]
    for n, (day, clock) in enumerate(runs, 1):
        landing.judge(store, str(tmp_path), specs, day, f"{day} {clock}", min(n, 3))
    assert late() == {f"{n}: FeedLate": (1, owner) for n in "ab"}
    # Nobody looked for two days: the windows that closed since are three.
    landing.judge(store, str(tmp_path), specs, "2026-09-06", "2026-09-06 23:00:00", 4)
    assert late() == {f"{n}: FeedLate": (4, owner) for n in "ab"}


def test_a_file_set_aside_is_neither_missing_nor_judged_again(spark, tmp_path, tmp_path_factory):
    import os

    texts, aside = tmp_path / "contracts", tmp_path_factory.mktemp("aside")
    put(texts, "a.yaml", yaml("a", dir="a", mask="A_{yyyyMMdd}.csv"))
    specs = contracts.check_rules(files.read(spark, str(texts))).filter("error is null").withColumn("version", F.lit(1).cast("bigint"))
    put(tmp_path / "landing" / "a", "A_20260903.csv", csv("MemberId,Amount", ["M1,1.5"]))
    stamp = dt.datetime.fromisoformat("2026-09-03 01:00:00+00:00").timestamp()
    path = next((tmp_path / "landing").rglob("A_*.csv"))
    os.utime(path, (stamp, stamp))
    store, root = Store(spark, str(tmp_path / "store")), str(tmp_path)
    landing.judge(store, root, specs, "2026-09-03", "2026-09-03 01:30:00", 1)
    assert [r.disposition for r in store.current("arrival").filter("feed_name = 'a'").collect()] == [vocab.QUARANTINED]
    quarantine.run(store, root, str(aside), 1, "2026-09-03 01:31:00")
    assert not path.exists() and [p.name for p in aside.rglob("*.csv")] == [path.name]
    landing.judge(store, root, specs, "2026-09-03", "2026-09-03 23:30:00", 2)
    assert store.log("validation").count() == 1
    assert {r.type for r in store.current("alert").collect()} == {vocab.SCHEMA_DRIFT}
    assert [(r.place, r.path.startswith(str(aside))) for r in quarantine.places(store, root).filter("feed_name = 'a'").collect()] == [(quarantine.ASIDE, True)]
