"""Guards and whole runs over small tables."""

import datetime
import itertools
import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.cli import printable, summary
from palimpsest.config import EngineConfig, RunOptions, Secret
from palimpsest.errors import ConstraintViolation, InvalidCategoricalColumn, InvalidConfiguration, UnpageableTable, UnsafeColumn
from palimpsest.functions.jsonpaths import JsonPaths
from palimpsest.functions.scalars import comparison_key
from palimpsest.functions.shapes import KeepLast, KeepLength, Pattern
from palimpsest.operators import jsondoc, relational
from palimpsest.operators.keyed import candidates, keyed_column, unique_mapping
from palimpsest.plans.engine import Engine
from palimpsest.plans.guards import Guards
from palimpsest.plans.identity import resolve_identity
from palimpsest.plans.rules import Codec, Expression, RuleSet, Target, keyed, keyed_pattern
from palimpsest.sources import tables
from palimpsest.sources.catalog import ForeignKey, SchemaCatalog
from palimpsest.streaming.rewrite import rewrite_stream, start

KEY = b"\x01" * 32


def engine(spark, frames, models=None, more=None, catalog=None, **config):
    frames = {k: v if hasattr(v, "schema") else spark.createDataFrame(*v) for k, v in frames.items()}
    catalog = catalog or {}
    catalog.setdefault("primary_keys", {k: ["id"] for k in frames})
    cat = SchemaCatalog.of({k: v.schema for k, v in frames.items()}, **catalog)
    config.setdefault("environment", "testing")
    config.setdefault("key", KEY)
    config.setdefault("run_seed", b"seed")
    return Engine(spark, EngineConfig(models=models or {}, tables=more or {}, **config), cat, frames)


def users(n=30):
    return ([(i, f"user{i}@example.com", ["member", "admin", "guest"][0 if i % 3 else i % 2 + 1], None if i % 5 == 0 else f"note {i}") for i in range(n)], "id long, email string, role string, note string")


def test_run_rewrites_declared_columns_alone(spark):
    e = engine(spark, {"users": users()}, {"users": RuleSet({"email": Pattern("??????@ex.test"), "note": "gone"})}, catalog={"unique": {"users": [["email"]]}})
    old = {r["id"]: r for r in e.frames["users"].collect()}
    events = []
    report = e.run(RunOptions(chunk_size=8, on_progress=events.append))
    new = {r["id"]: r for r in e.frames["users"].collect()}
    assert not report.failed and report.rows_sanitized == 30 and [c.rows for c in report.targets[0].chunks] == [8, 8, 8, 6]
    assert all(new[i]["role"] == old[i]["role"] and new[i]["note"] == "gone" for i in old)
    assert len({r["email"].lower() for r in new.values()}) == 30 and not {r["email"] for r in new.values()} & {r["email"] for r in old.values()}
    assert [x.chunk for x in events] == [None, 1, 2, 3, 4] and events[-1].rows == 30
    assert report.targets[0].changed == {"email": 30, "note": 30}
    assert report.to_df(spark).count() == 4


def test_dry_run_writes_nothing_and_counts_alike(spark):
    rules = RuleSet({"email": keyed_pattern("mail", "??????????"), "role": "x"}, categorical=["role"])
    e = engine(spark, {"users": users()}, {"users": rules})
    before = e.frames["users"].collect()
    dry = e.run(RunOptions(dry_run=True))
    assert e.frames["users"].collect() == before and dry.rows_sanitized == 0 and dry.targets[0].changed["email"] == 30
    wet = e.run()
    assert wet.targets[0].changed == dry.targets[0].changed
    assert "dry run" in summary(dry) and "30 rows sanitized" in summary(wet)


def test_keyed_values_agree_over_columns_tables_and_paths(spark):
    people = ([(1, "900101015555", None, '{"ic":"900101015555","n":1.0}'), (2, "880202026666", "900101015555", None)], "id long, nric string, alt string, doc string")
    contacts = ([(1, 900101015555)], "id long, nric long")
    value = keyed("nric", KeepLength())
    e = engine(spark, {"people": people, "contacts": contacts}, {"people": RuleSet({"nric": value, "alt": value, "doc": JsonPaths({"ic": value})}), "contacts": RuleSet({"nric": value})})
    e.run()
    a, b = e.frames["people"].orderBy("id").collect()
    expected = candidates(Secret(KEY), "nric", KeepLength(), ["900101015555"], [0])[0]
    assert a["nric"] == b["alt"] == expected and a["alt"] is None and a["doc"] == f'{{"ic":"{expected}","n":1.0}}'
    assert e.frames["contacts"].first()["nric"] == int(expected)


def serial(inputs, forbidden, shape, probes=100):
    owner, out = set(), {}
    for x in inputs:
        for p in range(probes):
            c = candidates(Secret(KEY), "ns", shape, [x], [p])[0]
            if c.lower() != x.lower() and c.lower() not in forbidden and c.lower() not in owner:
                owner.add(c.lower())
                out[x] = c
                break
        else:
            out[x] = None
    return out


@pytest.mark.parametrize("n, pattern", [(60, "##"), (12, "#")])
def test_unique_mapping_equals_serial_resolution(spark, n, pattern):
    inputs = [f"{i:0{len(pattern)}d}" if i < 5 else f"x{i}" for i in range(n)]
    random.Random(n).shuffle(inputs)
    forbidden = {x.lower() for x in inputs if len(x) == len(pattern)} if n == 60 else set()
    df = spark.createDataFrame([(x, i) for i, x in enumerate(inputs)], "canonical string, rank int")
    banned = spark.createDataFrame([(x,) for x in sorted(forbidden)], "key string")
    got = {r["canonical"]: r["output"] for r in unique_mapping(df, banned, Secret(KEY), "ns", Pattern(pattern), max_probes=24).collect()}
    want = serial(inputs, forbidden, Pattern(pattern), 24)
    # inputs of lower rank than the first that fails must agree; a run stops there
    fail = next((i for i, x in enumerate(inputs) if want[x] is None), n)
    assert {x: got[x] for x in inputs[:fail]} == {x: want[x] for x in inputs[:fail]}
    assert [x for x in inputs if got[x] is None] == [x for x in inputs if want[x] is None]


def test_mirrors_keep_references(spark):
    customers = ([(i, f"C-{i}") for i in range(20)], "id long, nric string")
    orders = ([(i, f"C-{i % 20}" if i % 7 else None) for i in range(50)], "id long, customer string")
    value = keyed_pattern("nric", "C-##")
    catalog = {"unique": {"customers": [["nric"]]}, "foreign_keys": [ForeignKey("orders", ("customer",), "customers", ("nric",))]}
    e = engine(spark, {"customers": customers, "orders": orders}, {"customers": RuleSet({"nric": value}, mirrors={"nric": ["orders.customer"]}), "orders": RuleSet({"customer": value}, mirrors={"customer": ["customers.nric"]})}, catalog=catalog)
    report = e.run()
    assert relational.orphans(e.frames["orders"], ["customer"], e.frames["customers"], ["nric"]).count() == 0
    new = {r["nric"] for r in e.frames["customers"].collect()}
    assert len(new) == 20 and not new & {f"C-{i}" for i in range(20)}
    assert e.frames["orders"].where("customer is null").count() == 8 and not report.targets[0].fk_enforcement


def test_bad_chunk_stops_the_run(spark):
    bad = Expression(lambda c: F.when(F.col("id") == 13, F.lit("x" * 99)).otherwise(F.lit("ok")))
    frames = {"users": users(), "later": users(3)}
    e = engine(spark, frames, {"users": RuleSet({"note": bad}), "later": RuleSet({"note": "y"})}, catalog={"columns": {"users": {"note": {"max_length": 20}}}})
    report = e.run(RunOptions(chunk_size=5))
    rows = {r["id"]: r["note"] for r in e.frames["users"].collect()}
    assert all(rows[i] == "ok" for i in range(10)) and rows[11] == "note 11" and rows[20] is None
    t = report.targets[0]
    assert [c.status for c in t.chunks] == ["committed", "committed", "rolled_back"] and t.chunks_not_attempted == 3 and t.changed == {"note": 10}
    assert report.not_attempted == ["later"] and e.frames["later"].first()["note"] != "y"
    assert "x" * 99 not in summary(report) and "keys 10 to 14" in summary(report)


def test_categories_keep_their_shares(spark):
    rows = [(i, "active" if i < 840 else "pending" if i < 1080 else "banned") for i in range(1200)]
    e = engine(spark, {"t": (rows, "id long, status string")}, {"t": RuleSet({"status": "unused"}, categorical=["status"])})
    e.run()
    share = {r["status"]: r["count"] / 1200 for r in e.frames["t"].groupBy("status").count().collect()}
    assert set(share) == {"active", "pending", "banned"} and abs(share["active"] - 0.7) < 0.05 and abs(share["banned"] - 0.1) < 0.05


def test_unique_tuples_and_exhaustion(spark):
    rows = [(i, "t", f"s{i}" if i % 4 else None) for i in range(20)]
    catalog = {"unique": {"t": [["tenant", "slug"]]}}
    e = engine(spark, {"t": (rows, "id long, tenant string, slug string")}, {"t": RuleSet({"slug": Pattern("##")})}, catalog=catalog)
    e.run()
    made = [r["slug"] for r in e.frames["t"].collect() if r["slug"]]
    assert len(made) == len(set(made)) == 15
    e = engine(spark, {"t": (rows, "id long, tenant string, slug string")}, {"t": RuleSet({"slug": Pattern("#")})}, catalog=dict(catalog))
    assert e.run().failed
    e = engine(spark, {"t": (rows, "id long, tenant string, slug string")}, {"t": RuleSet({"slug": "same"})}, catalog=dict(catalog))
    assert "collide" in e.run().targets[0].chunks[-1].error


def test_reruns(spark):
    rules = RuleSet({"email": keyed_pattern("mail", "????????"), "note": Pattern("????????")})
    first, second = (engine(spark, {"users": users()}, {"users": rules}, run_seed=s) for s in (b"1", b"2"))
    first.run()
    second.run()
    a, b = (x.frames["users"].orderBy("id").collect() for x in (first, second))
    assert [r["email"] for r in a] == [r["email"] for r in b] and [r["note"] for r in a] != [r["note"] for r in b]
    assert [r["note"] is None for r in a] == [r[3] is None for r in users()[0]]


def test_bad_documents_and_codecs(spark):
    e = engine(spark, {"t": ([(1, '{"a":1}'), (2, "{")], "id long, doc string")}, {"t": RuleSet({"doc": JsonPaths({"a": 2})})})
    report = e.run()
    assert report.failed and "valid JSON" in report.targets[0].chunks[0].error and e.frames["t"].orderBy("id").first()["doc"] == '{"a":1}'
    hidden = Codec(encode=lambda c: F.base64(c.cast("binary")), decode=lambda c: F.unbase64(c).cast("string"))
    e = engine(spark, {"t": ([(1, "YWJj")], "id long, ssn string")}, {"t": RuleSet({"ssn": keyed("ssn", KeepLast(1))}, codecs={"ssn": hidden})})
    e.run()
    assert e.frames["t"].select(F.unbase64("ssn").cast("string")).first()[0][-1] == "c"


def test_paths_reach_into_arrays_structs_and_maps(spark):
    kind = "id long, tags array<string>, who struct<name: string, born: date, ids: array<bigint>>, more map<string, string>"
    rows = [(1, ["a", "b", None], ("Ann", None, [1, 2]), {"k": "v", "o": None}), (2, None, None, None), (3, [], ("", None, None), {})]
    value = keyed("name", KeepLength())
    rules = RuleSet({"tags": JsonPaths({"*": "-"}), "who": JsonPaths({"name": value, "ids->*": 0}), "more": JsonPaths({"k": value})})
    e = engine(spark, {"t": (rows, kind)}, {"t": rules})
    schema = e.frames["t"].schema
    report = e.run()
    new = {r["id"]: r for r in e.frames["t"].collect()}
    name = candidates(Secret(KEY), "name", KeepLength(), ["Ann", "v"], [0, 0])
    assert not report.failed and e.frames["t"].schema.simpleString() == schema.simpleString()
    assert new[1]["tags"] == ["-", "-", None] and new[1]["who"].asDict() == {"name": name[0], "born": None, "ids": [0, 0]} and new[1]["more"] == {"k": name[1], "o": None}
    assert (new[2]["tags"], new[2]["who"], new[2]["more"]) == (None, None, None) and new[3]["tags"] == [] and new[3]["more"] == {}
    assert report.targets[0].changed == {"tags": 1, "who": 1, "more": 1}  # an empty name keeps its length
    bad = engine(spark, {"t": (rows, kind)}, {"t": RuleSet({"who": JsonPaths({"ids->*": "no number"})})}).run()
    assert bad.targets[0].failed_chunk.error == "who: type_mismatch"


def test_failing_expressions_codecs_and_bytes_are_errors_of_their_rows(spark):
    frame = spark.createDataFrame([(i, str(i) if i != 7 else "seven", None) for i in range(12)], "id long, text string, other string")
    for rules, error in (
        (RuleSet({"text": Expression(lambda c: c.cast("int").cast("string"))}), "text: the expression fails (message withheld)"),
        (RuleSet({"text": "9"}, codecs={"text": Codec(encode=lambda c: c, decode=lambda c: c.cast("int").cast("string"))}), "text: the codec can't decode the stored value (message withheld)"),
        (RuleSet({"text": Expression(lambda c: c)}, codecs={"text": Codec(encode=lambda c: c.cast("int").cast("string"))}), "text: the codec can't encode the new value (message withheld)"),
    ):
        e = engine(spark, {"t": frame}, {"t": rules})
        t = e.run(RunOptions(chunk_size=5)).targets[0]
        assert t.failed_chunk.chunk == 2 and t.failed_chunk.error == error and t.rows_sanitized == 5
    broken = frame.withColumn("text", F.when(F.col("id") == 7, F.unhex(F.lit("ff61")).cast("string")).otherwise(F.col("text")))
    for definition in (KeepLength(), keyed("n", KeepLength()), JsonPaths({"a": 1})):
        e = engine(spark, {"t": broken}, {"t": RuleSet({"text": definition})})
        assert e.run(RunOptions(chunk_size=5)).targets[0].failed_chunk.error == "text: the value is not valid UTF-8"


def test_names_are_found_whatever_their_case(spark):
    frame = spark.createDataFrame(users(6)[0], "Id long, eMail string, role string, note string")
    catalog = {"primary_keys": {"users": ["ID"]}, "unique": {"users": [["EMAIL"]]}, "foreign_keys": [ForeignKey("orders", ("USER_ID",), "users")]}
    frames = {"users": frame, "orders": spark.createDataFrame(*ORDERS)}
    e = engine(spark, frames, {"users": RuleSet({"EMail": keyed_pattern("mail", "????????")})}, catalog=catalog)
    assert e.catalog.foreign_keys == (ForeignKey("orders", ("user_id",), "users", ("Id",)),) and len(e.catalog.referencing("users")) == 1
    report = e.run()
    assert report.targets[0].changed == {"eMail": 6} and e.frames["users"].columns == frame.columns
    with pytest.raises(UnsafeColumn):
        engine(spark, frames, {"orders": RuleSet({"User_ID": 1})}, catalog=dict(catalog)).run()


def test_no_old_value_is_left_in_the_scratch_folder(spark):
    names = [f"Person Number {i}" for i in range(20)]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.rglob("*.parquet"))
    e = engine(spark, {"t": frame}, {"t": RuleSet({"name": keyed_pattern("name", "????????")})}, catalog={"unique": {"t": [["name"]]}})
    e.run()
    left = {p.parent for p in set(root.rglob("*.parquet")) - before}
    found = [str(v) for folder in left for r in spark.read.parquet(str(folder)).collect() for v in r]
    assert len(left) == 2 and e.frames["t"].count() == 20  # the snapshot, and the report's chunks
    assert not any(n in v for n in names for v in found)


def test_python_functions_see_the_row(spark):
    e = engine(spark, {"users": users(4)}, {"users": RuleSet({"note": lambda value, row: f"{row['role']}:{value}"})})
    e.run()
    assert [r["note"] for r in e.frames["users"].orderBy("id").collect()] == ["admin:None", "member:note 1", "member:note 2", "guest:note 3"]


def test_failures_of_callers_functions_are_withheld(spark):
    e = engine(spark, {"users": users(4)}, {"users": RuleSet({"note": lambda value, row: 1 / row["id"]})})
    report = e.run()
    assert report.failed and report.targets[0].chunks[0].error == "note: ZeroDivisionError (message withheld)"


def test_models_of_other_tables_and_without_rules(spark):
    e = engine(spark, {"users": users(4)}, {"User": RuleSet({"note": "x"}, table="users", key_name="id"), "Other": None}, {"users": RuleSet({"role": "y"})}, catalog={"primary_keys": {}})
    report = e.run()
    assert [t.target for t in report.targets] == ["User", "Other", "table:users"] and report.targets[1].skipped == "no-sanitizer"
    assert {(r["note"], r["role"]) for r in e.frames["users"].collect()} == {("x", "y")}
    assert [t.target for t in e.run(RunOptions(targets=["User"])).targets] == ["User"]


def test_rules_by_naming_convention_classes_by_path_and_other_guards(spark):
    rules = RuleSet({"note": "palimpsest.functions.shapes.Nric", "role": "no.such.Class"})
    seen = []
    e = engine(spark, {"users": users(4)}, {"app.users": None, "app.Other": None}, sanitizers={"usersSanitizer": replace(rules, table="users")})
    e.checks = Guards(quality=lambda t, r, c: seen.append(t.label))
    report = e.run()
    assert [t.skipped for t in report.targets] == [None, "no-sanitizer"] and seen == ["app.users"]
    made = e.frames["users"].orderBy("id").collect()
    assert made[0]["note"] is None and made[1]["note"].replace("-", "").isdigit() and made[1]["role"] == "no.such.Class"


def test_a_failing_probe_proves_nothing(spark):
    frame = spark.range(4).select(F.col("id"), F.col("id").cast("string").alias("email"), F.expr("if(id = 3, raise_error('x'), id)").alias("code"))
    found = resolve_identity(frame, Target("t", "t", RuleSet({"email": "x"})), RuleSet({"email": "x"}), SchemaCatalog.of({"t": frame.schema}, unique={"t": [["code"], ["id"]]}).tables["t"])
    assert found.columns == ("id",) and found.source == "unique"


FK = {"foreign_keys": [ForeignKey("orders", ("user_id",), "users", ("id",)), ForeignKey("orders", ("code",), "users", ("email",))]}
ORDERS = ([(1, 1, "c")], "id long, user_id long, code string")


@pytest.mark.parametrize(
    "models, error",
    [
        ({"users": RuleSet({})}, InvalidConfiguration),
        ({"users": RuleSet({"nope": 1})}, UnsafeColumn),
        ({"users": RuleSet({"id": 1})}, UnsafeColumn),
        ({"users": RuleSet({"email": "x"})}, UnsafeColumn),
        ({"orders": RuleSet({"user_id": 1})}, UnsafeColumn),
        ({"users": RuleSet({"role": "x"}, mirrors={"note": ["orders.code"]})}, InvalidConfiguration),
        ({"users": RuleSet({"note": "x"}, mirrors={"note": ["orders.code"]})}, InvalidConfiguration),
        ({"users": RuleSet({"email": keyed_pattern("a", "#")}, mirrors={"email": ["orders.code"]})}, InvalidConfiguration),
        ({"users": RuleSet({"email": keyed_pattern("a", "#")}, mirrors={"email": ["users.email"]})}, InvalidConfiguration),
        ({"users": RuleSet({"note": "x"}, categorical=["role"])}, InvalidCategoricalColumn),
        ({"users": RuleSet({"note": keyed_pattern("a", "#")}, categorical=["note"])}, InvalidCategoricalColumn),
        ({"users": RuleSet({"role": keyed_pattern("a", "#"), "note": keyed_pattern("a", "##")})}, InvalidConfiguration),
        ({"users": RuleSet({"role": "not allowed"})}, ConstraintViolation),
    ],
)
def test_guards_refuse_before_any_job(spark, models, error):
    catalog = dict(FK, columns={"users": {"role": {"allowed": ("member",)}}})
    e = engine(spark, {"users": users(3), "orders": ORDERS}, models, catalog=catalog)
    spark.sparkContext.setJobGroup("guard", "guard")
    with pytest.raises(error):
        e.run()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("guard")
    spark.sparkContext.setJobGroup("rest", "rest")


def test_key_is_needed_only_for_keyed_values_and_never_shown(spark):
    e = engine(spark, {"users": users(3)}, {"users": RuleSet({"note": "x"})}, key=None)
    assert not e.run().failed
    with pytest.raises(InvalidConfiguration):
        engine(spark, {"users": users(3)}, {"users": RuleSet({"note": keyed_pattern("a", "##")})}, key=None).run()
    df = spark.range(1).select(keyed_column(Secret(b"k3y" * 20), "n", Pattern("#"), F.lit("v")).alias("x"))
    assert "k3y" not in df._jdf.queryExecution().toString()


def test_identity_fallback_and_refusal(spark):
    rows = [(a, b, f"{i}") for i, (a, b) in enumerate(itertools.product("abc", "xyz"))]
    e = engine(spark, {"p": (rows, "first string, last string, email string")}, {"p": RuleSet({"email": "x"})}, catalog={"primary_keys": {}})
    assert e.run(RunOptions(chunk_size=4)).targets[0].expected_chunks == 3
    e = engine(spark, {"p": (rows + rows[:1], "first string, last string, email string")}, {"p": RuleSet({"email": "x"})}, catalog={"primary_keys": {}})
    with pytest.raises(UnpageableTable):
        e.run()


def test_comparison_keeps_case_variants_together(spark):
    df = spark.createDataFrame([("Ab",), ("aB",), (None,)], "v string").select(comparison_key(F.col("v")).alias("k"))
    assert df.distinct().count() == 2


def test_snapshots_are_swapped(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    tables.replace_snapshot(tables.read(spark, path).selectExpr("id + 10 as id"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [10, 11, 12] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception):
        tables.replace_snapshot(spark.range(1).selectExpr("raise_error('x') as id"), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_streams(spark, tmp_path):
    rules = RuleSet({"email": keyed_pattern("mail", "??????"), "note": "gone", "role": Expression(F.upper)})
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame(*users(5)).write.parquet(source)
    stream = spark.readStream.schema(users()[1]).parquet(source)
    q = start(stream, rules, Secret(KEY), lambda b, epoch: out.extend(b.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    batch = rewrite_stream(spark.createDataFrame(*users(5)), rules, Secret(KEY)).collect()
    assert sorted(out) == sorted(batch) and len(out) == 5
    with pytest.raises(InvalidConfiguration):
        rewrite_stream(stream, RuleSet({"note": Pattern("#")}), Secret(KEY))


def test_printable_keys():
    assert printable({"id": 5}) == "5" and printable({"a": 1, "b": 2}) == "a=1, b=2"
    assert printable({"id": "me@x.test"}) is None and printable("01ARZ3NDEKTSV4RRFFQ69G5FAV") is not None


def test_constants_in_arrays_and_structs_are_placed_without_text(spark, monkeypatch):
    """Equal to rewriting the text, all other members kept to the microsecond; no row of them goes through Python."""
    kind = "id long, tags array<string>, who struct<name: string, born: timestamp, ids: array<bigint>, marks: array<struct<k: string, on: boolean>>>"
    born = datetime.datetime(2001, 2, 3, 4, 5, 6, 789123)
    rows = [(1, ["a", None, '"'], ("Ann", born, [1, None, 3], [("x", True), None, (None, None)])), (2, None, None), (3, [], (None, None, [], [])), (4, ["-"], ("gone", born, None, None))]
    rules = RuleSet({"tags": JsonPaths({"*": "-"}), "who": JsonPaths({"name": "gone", "ids->2": 7, "marks->*->on": False, "Name": "no such member", "born->x": 1})})
    by_text = engine(spark, {"t": ([(*r[:2], r[2] and (r[2][0], None, *r[2][2:])) for r in rows], kind)}, {"t": rules})
    monkeypatch.setattr(jsondoc, "constant_column", lambda *a: None)
    by_text.run()
    monkeypatch.undo()
    monkeypatch.setattr(jsondoc, "rewrite_column", None)
    e = engine(spark, {"t": (rows, kind)}, {"t": rules})
    report = e.run()
    assert not report.failed and report.targets[0].changed == {"tags": 1, "who": 1}
    new = {r["id"]: r for r in e.frames["t"].collect()}
    assert new[1]["who"]["born"] == born and new[1]["who"]["marks"][0]["on"] is False and new[1]["tags"] == ["-", None, "-"]
    plain = {r["id"]: r for r in e.frames["t"].withColumn("who", F.col("who").withField("born", F.lit(None).cast("timestamp"))).collect()}
    assert plain == {r["id"]: r for r in by_text.frames["t"].collect()}


@pytest.mark.parametrize("path, value", [("m->k", "x"), ("n", "1"), ("n", 1 << 40), ("s", 1), ("s", ["x"]), ("*", "x")])
def test_constants_of_other_types_and_maps_go_through_text(path, value):
    kind = T.StructType().add("m", T.MapType(T.StringType(), T.StringType())).add("s", T.StringType()).add("n", T.IntegerType())
    for fields in (kind.fields, kind.fields[1:]):
        if path != "m->k" or len(fields) == 3:
            assert jsondoc.constant_column(JsonPaths({path: value}), {path: value}, None, T.StructType(fields)) is None
