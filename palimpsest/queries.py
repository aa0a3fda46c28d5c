"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ChunkConfig, EngineConfig, RunOptions, Secret
from .functions import shapes
from .functions.jsonpaths import JsonPaths
from .functions.prng import SEPARATOR, VALUE_PREFIX
from .functions.scalars import canonical, canonical_number, comparison_key, hmac_sha256, mask_characters, printable_key
from .functions.shapes import Pattern, Shape
from .operators import jsondoc, relational
from .operators.keyed import keyed_column, unique_mapping
from .operators.unique import random_column, redraw_until_unique
from .plans import validate
from .plans.engine import Engine
from .plans.guards import components
from .plans.identity import chunk_of, with_position
from .plans.rules import Expression, RuleSet, keyed, keyed_pattern
from .sources.catalog import ColumnInfo, ForeignKey, SchemaCatalog

#: A public test key, the same as in the SQL below.
TEST_KEY = Secret(b"\x01" * 32)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row(spark: SparkSession, **values: Column) -> DataFrame:
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()])


# -- relational queries --------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def profile_mktsegment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.frequency_profile(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT count(*) AS n, count(*) > 1000 AS too_many FROM (SELECT DISTINCT p_name FROM part LIMIT 1001)")
def profile_guard_part_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.frequency_profile(table(spark, sf_dir, "part"), "p_name").limit(relational.MAX_CATEGORIES + 1)
    return found.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > relational.MAX_CATEGORIES).alias("too_many"))


@query("SELECT count(*) AS n FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)")
def unique_probe_custkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicated(table(spark, sf_dir, "customer"), ["c_custkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def unique_probe_lineitem_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (text IS NULL) AS text, count(*) FILTER (lang IS NULL) AS lang,
count(*) FILTER (source IS NULL) AS source FROM documents""")
def not_null_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.null_counts(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"])


@query("SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def distinct_seed_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_tuples(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT lower(c_name) AS key FROM customer WHERE c_name IS NOT NULL UNION SELECT lower(s_name) FROM supplier WHERE s_name IS NOT NULL")
def forbidden_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.forbidden_originals([(table(spark, sf_dir, "customer"), "c_name"), (table(spark, sf_dir, "supplier"), "s_name")])


SIZES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES)


@query(f"""SELECT name, n, CASE WHEN n <= 500 THEN greatest(n, 1) ELSE greatest(500, least(5000, ceil(n / 20.0)::BIGINT)) END AS size,
ceil(n / (CASE WHEN n <= 500 THEN greatest(n, 1) ELSE greatest(500, least(5000, ceil(n / 20.0)::BIGINT)) END)::DOUBLE)::BIGINT AS chunks FROM ({SIZES_SQL})""")
def chunk_sizes_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk, rows = ChunkConfig(), []
    for t in TABLES:
        n = table(spark, sf_dir, t).count()
        rows.append((t, n, chunk.size_for(n), -(-n // chunk.size_for(n))))
    return spark.createDataFrame(rows, "name string, n bigint, size bigint, chunks bigint")


BOUNDS_SQL = """SELECT ((pos - 1) // 100) + 1 AS chunk_id, count(*) AS n_rows, min(conv_id) AS first_conv, arg_min(turn, pos) AS first_turn,
arg_max(conv_id, pos) AS last_conv, arg_max(turn, pos) AS last_turn
FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations) GROUP BY 1"""


def _conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_position(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ("conv_id", "turn"), "pos")
    return relational.chunk_bounds(placed.withColumn("chunk_id", chunk_of(F.col("pos"), 100)), "chunk_id", ["conv_id", "turn"])


@query(BOUNDS_SQL)
def chunk_bounds_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _conversation_chunks(spark, sf_dir)
    return b.select("chunk_id", "n_rows", F.col("first.conv_id").alias("first_conv"), F.col("first.turn").alias("first_turn"), F.col("last.conv_id").alias("last_conv"), F.col("last.turn").alias("last_turn"))


@query(f"SELECT chunk_id, n_rows, (sum(n_rows) OVER (ORDER BY chunk_id))::BIGINT AS done FROM ({BOUNDS_SQL})")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.running_rows(_conversation_chunks(spark, sf_dir).select("chunk_id", "n_rows"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 50")
def keyset_page_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keyset_page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], [100], 50)


COMPOSITE_SQL = "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) > (5, 1) ORDER BY conv_id, turn LIMIT 50"


@query(COMPOSITE_SQL)
def keyset_page_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keyset_page(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], [5, 1], 50)


@query(COMPOSITE_SQL)
def keyset_page_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keyset_page(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], [5, 1], 50, expanded=True)


@query("SELECT count(*) AS n FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)")
def fk_orphans_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.orphans(table(spark, sf_dir, "orders"), ["o_custkey"], table(spark, sf_dir, "customer"), ["c_custkey"]).agg(F.count(F.lit(1)).alias("n"))


EDGES = [("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_orderkey", "orders.o_orderkey"), ("customer.c_nationkey", "nation.n_nationkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("nation.n_regionkey", "region.r_regionkey")]
EDGES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)


@query(f"""WITH RECURSIVE e(a, b) AS (VALUES {EDGES_SQL}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, other) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def mirror_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    def split(x: str) -> tuple[str, str]:
        t, _, c = x.partition(".")
        return t, c

    groups = components([(split(a), split(b)) for a, b in EDGES])
    rows = [(".".join(n), ".".join(min(g))) for g in groups for n in g]
    return spark.createDataFrame(rows, "node string, component string")


@query(f"SELECT child, parent FROM (VALUES {EDGES_SQL}) e(child, parent) WHERE (child IN ('orders.o_custkey', 'nation.n_nationkey')) <> (parent IN ('orders.o_custkey', 'nation.n_nationkey'))")
def fk_closure_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame([("orders.o_custkey",), ("nation.n_nationkey",)], "node string")
    return relational.fk_closure_violations(spark.createDataFrame(EDGES, "child string, parent string"), members)


# -- scalar functions ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, lower(c_name) AS key FROM customer")
def comparison_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), comparison_key(F.col("c_name")).alias("key"))


@query("""SELECT c_custkey AS id, form, CASE form WHEN 4 THEN NULL WHEN 3 THEN '-' || c_custkey || '.5' ELSE c_custkey::VARCHAR END AS number
FROM customer, (VALUES (0), (1), (2), (3), (4)) f(form)""")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    forms = F.array(F.concat(F.lit("00"), key), F.concat(F.lit("+"), key), F.concat(key, F.lit(".00")), F.concat(F.lit("-0"), key, F.lit(".50")), F.concat(key, F.lit("e1")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(forms).alias("form", "text"))
    return rows.select("id", "form", canonical_number(F.col("text")).alias("number"))


@query("SELECT c_custkey AS id, true AS int_key, false AS name_key, true AS uuid_key FROM customer")
def key_withholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    text = c.schema["c_name"].dataType
    return c.select(F.col("c_custkey").alias("id"), printable_key(F.col("c_custkey"), c.schema["c_custkey"].dataType).alias("int_key"), printable_key(F.col("c_name"), text).alias("name_key"), printable_key(uuid, text).alias("uuid_key"))


@query("SELECT 'c' || c_custkey AS id, regexp_replace(c_name, '[\\p{N}\\p{L}]', '*', 'g') AS masked FROM customer UNION ALL SELECT 'd' || doc_id, regexp_replace(source, '[\\p{N}\\p{L}]', '*', 'g') FROM documents")
def mask_keep_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), mask_characters(F.col("c_name"), "*").alias("masked"))
    return c.unionAll(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id"), mask_characters(F.col("source"), "*")))


# -- keyed replacements ----------------------------------------------------------------------------------------------------


def _hmac_sql(message: str) -> str:
    inner, outer = "37" * 32 + "36" * 32, "5d" * 32 + "5c" * 32
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}') || encode({message}))))"


def _seed_sql(namespace: str, text: str) -> str:
    return _hmac_sql(f"'{VALUE_PREFIX}' || chr(31) || '{namespace}' || chr(31) || {text} || chr(31) || '0'")


def keyed_sql(source: str, key: str, text: str, namespace: str, draws: int, output: str) -> str:
    """The generator of every row as a recursive query over 128-bit integers: d(id, v, i, r) has the i-th 32 bits drawn."""
    mask = "18446744073709551615::HUGEINT"

    def word(i: int) -> str:
        return "('0x' || " + " || ".join(f"substr(h, {i * 16 + j}, 2)" for j in range(15, 0, -2)) + ")::UBIGINT::HUGEINT"

    def rot(x: str, k: int) -> str:
        return f"(((({x}) << {k}) & {mask}) | (({x}) >> {64 - k}))"

    result = f"((({rot(f'(s1 * 5) & {mask}', 7)} * 9) & {mask}) & 4294967295::HUGEINT)::BIGINT"
    return f"""
WITH RECURSIVE src AS (SELECT {key} AS id, {text} AS v FROM {source}),
seeds AS (SELECT id, v, {_seed_sql(namespace, 'v')} AS h FROM src),
g(id, v, i, r, s0, s1, s2, s3) AS (
  SELECT id, v, 0, 0::BIGINT, {word(0)}, {word(1)}, {word(2)}, {word(3)} FROM seeds
  UNION ALL
  SELECT id, v, i + 1, {result}, xor(xor(s0, s3), s1), xor(xor(s1, s2), s0), xor(xor(s2, s0), (s1 << 17) & {mask}), {rot('xor(s3, s1)', 45)}
  FROM g WHERE i < {draws}),
d AS (SELECT id, v, i, r FROM g WHERE i > 0)
{output}"""


def _kept_sql(source: str, key: str, text: str, namespace: str, keep: str, draws: int) -> str:
    """``keep``: whether the code point at p of a value of n code points stays."""
    chars = f"""
, chars AS (SELECT id, v, p, n, c, CASE WHEN {keep} THEN '' WHEN regexp_matches(c, '\\p{{N}}') THEN 'N' WHEN regexp_matches(c, '\\p{{Lu}}') THEN 'U' WHEN regexp_matches(c, '\\p{{L}}') THEN 'L' ELSE '' END AS kind
  FROM (SELECT id, v, unnest(range(1, length(v) + 1)) AS p, length(v) AS n, substr(v, unnest(range(1, length(v) + 1)), 1) AS c FROM src)),
numbered AS (SELECT *, sum(CASE WHEN kind <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS i FROM chars)
SELECT n.id, string_agg(CASE kind WHEN 'N' THEN (r % 10)::VARCHAR WHEN 'U' THEN chr((65 + r % 26)::INTEGER) WHEN 'L' THEN chr((97 + r % 26)::INTEGER) ELSE c END, '' ORDER BY p) AS output
FROM numbered n LEFT JOIN d ON d.id = n.id AND d.i = n.i AND kind <> '' GROUP BY n.id"""
    return keyed_sql(source, key, text, namespace, draws, chars)


def _keyed(spark: SparkSession, sf_dir: str, name: str, key: str, text: Column | str, namespace: str, shape: Shape) -> DataFrame:
    df = table(spark, sf_dir, name)
    value = canonical(F.col(text), df.schema[text].dataType) if isinstance(text, str) else text
    return df.select(F.col(key).alias("id"), keyed_column(TEST_KEY, namespace, shape, value).alias("output"))


@query(f"SELECT c_custkey AS id, {_seed_sql('seed', 'c_name')} AS seed FROM customer")
def keyed_seed_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit(f"{VALUE_PREFIX}{SEPARATOR}seed{SEPARATOR}"), "c_name", F.lit(f"{SEPARATOR}0"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hmac_sha256(TEST_KEY.reveal(), message).alias("seed"))


@query(keyed_sql("customer", "c_custkey", "c_name", "digits", 6, "SELECT id, string_agg((r % 10)::VARCHAR, '' ORDER BY i) AS output FROM d GROUP BY id"))
def keyed_pattern_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_name", "digits", Pattern("######"))


@query(keyed_sql("supplier", "s_suppkey", "s_name", "mixed", 3, """SELECT id, string_agg(CASE i WHEN 1 THEN (r % 10)::VARCHAR WHEN 2 THEN chr((65 + r % 26)::INTEGER)
ELSE substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', (r % 36)::INTEGER + 1, 1) END, '' ORDER BY i) AS output FROM d GROUP BY id"""))
def keyed_pattern_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "supplier", "s_suppkey", "s_name", "mixed", Pattern("#?*"))


@query(_kept_sql("customer", "c_custkey", "c_name", "last", "p > n - 4", 18))
def keyed_keep_last4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_name", "last", shapes.keep_last(4))


@query(_kept_sql("customer", "c_custkey", "c_name", "prefix", "p <= 9", 18))
def keyed_keep_prefix9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_name", "prefix", shapes.keep_prefix(9))


@query(_kept_sql("customer", "c_custkey", "c_name", "length", "false", 18))
def keyed_keep_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_name", "length", shapes.keep_length())


@query(_kept_sql("customer", "c_custkey", "lower(replace(c_name, '#', '.')) || '@example.com'", "mail", "p > n - 12", 18))
def keyed_keep_email_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return _keyed(spark, sf_dir, "customer", "c_custkey", mail, "mail", shapes.keep_email_domain())


STATES_SQL = "[" + ", ".join(f"'{s}'" for s in shapes.STATES) + "]"


@query(keyed_sql("customer", "c_custkey", "c_custkey::VARCHAR", "state", 1, f"SELECT id, {STATES_SQL}[(r & 15) + 1] AS output FROM d"))
def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_custkey", "state", shapes.State())


PLACES_SQL = "[" + ", ".join(f"'{p}'" for p in shapes.BIRTH_PLACES) + "]"


@query(keyed_sql("customer", "c_custkey", "c_custkey::VARCHAR", "nric", 4, f"""SELECT id, strftime(DATE '1940-01-01' + max(CASE i WHEN 1 THEN r % 25933 END)::INTEGER, '%y%m%d')
|| {PLACES_SQL}[max(CASE i WHEN 2 THEN r % 55 END) + 1] || lpad(max(CASE i WHEN 3 THEN r % 1000 END)::VARCHAR, 3, '0') || max(CASE i WHEN 4 THEN r % 10 END)::VARCHAR AS output FROM d GROUP BY id"""))
def keyed_nric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_custkey", "nric", shapes.Nric())


# the serial number redraws while the 32 bits exceed the last multiple of 10^8; the other draws practically never do
@query(keyed_sql("customer", "c_custkey", "c_custkey::VARCHAR", "sst", 10, """SELECT id, CASE WHEN max(CASE i WHEN 1 THEN r & 1 END) = 0 THEN 'W10' ELSE 'B16' END || '-'
|| lpad(((max(CASE i WHEN 2 THEN r % 100 END) + 224) // 12)::VARCHAR, 2, '0') || lpad(((max(CASE i WHEN 2 THEN r % 100 END) + 224) % 12 + 1)::VARCHAR, 2, '0') || '-'
|| lpad((arg_min(r, i) FILTER (i >= 3 AND r <= 4294967295 - 4294967295 % 100000000 - 1) % 100000000)::VARCHAR, 8, '0') AS output FROM d GROUP BY id"""))
def keyed_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_custkey", "sst", shapes.Sst())


@query(keyed_sql("customer", "c_custkey", "c_custkey::VARCHAR", "bank", 17, """, b AS (SELECT id, [12, 14, 10, 14, 11, 13, 14, 16][(r & 7) + 1] AS n FROM d WHERE i = 1)
SELECT d.id, string_agg(CASE WHEN i = 2 THEN (1 + r % 9)::VARCHAR ELSE (r % 10)::VARCHAR END, '' ORDER BY i) AS output FROM d JOIN b USING (id) WHERE i BETWEEN 2 AND n + 1 GROUP BY d.id"""))
def keyed_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "customer", "c_custkey", "c_custkey", "bank", shapes.BankAccount())


@query("SELECT count(*) AS n, count(*) AS valid FROM customer")
def nric_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _keyed(spark, sf_dir, "customer", "c_custkey", "c_name", "nric", shapes.Nric(hyphen=True))
    day = F.try_to_timestamp(F.concat(F.lit("19"), F.substring("output", 1, 6)), F.lit("yyyyMMdd"))
    day = F.coalesce(day, F.try_to_timestamp(F.concat(F.lit("20"), F.substring("output", 1, 6)), F.lit("yyyyMMdd")))
    good = F.col("output").rlike(r"^\d{6}-(0[1-9]|1[0-6]|2[1-9]|[34]\d|5\d)-\d{4}\z") & day.isNotNull()
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("valid"))


PATTERN_SQL = "SELECT id, string_agg({symbol}, '' ORDER BY i) AS output FROM d GROUP BY id"
LETTER_SQL = "chr((65 + r % 26)::INTEGER)"


def _letters_sql(source: str, key: str, text: str, namespace: str, n: int) -> str:
    return keyed_sql(source, key, text, namespace, n, PATTERN_SQL.format(symbol=LETTER_SQL))


@query(f"SELECT o_orderkey AS id, k.output AS customer FROM orders JOIN ({_letters_sql('customer', 'c_custkey', 'c_custkey::VARCHAR', 'cust', 12)}) k ON o_custkey = k.id")
def keyed_cross_table_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's replacement: made from the orders' own column, and found again among the customers'."""
    shape = Pattern("????????????")
    o = _keyed(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "cust", shape)
    c = _keyed(spark, sf_dir, "customer", "c_custkey", "c_custkey", "cust", shape)
    return o.join(c.select("output"), "output").select("id", F.col("output").alias("customer"))


@query(f"SELECT id, output AS a, output AS b FROM ({_letters_sql('customer', 'c_custkey', 'c_custkey::VARCHAR', 'same', 8)})")
def keyed_int_equals_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    number = keyed_column(TEST_KEY, "same", Pattern("????????"), canonical(F.col("c_custkey"), c.schema["c_custkey"].dataType))
    text = keyed_column(TEST_KEY, "same", Pattern("????????"), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), number.alias("a"), text.alias("b"))


@query(f"SELECT id AS canonical, output FROM ({_letters_sql('(SELECT DISTINCT s_name FROM supplier)', 's_name', 's_name', 'supplier', 16)})")
def unique_mapping_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a namespace so wide that every input has its first candidate."""
    s = table(spark, sf_dir, "supplier")
    inputs = s.groupBy(F.col("s_name").alias("canonical")).agg(F.min("s_suppkey").alias("rank"))
    return unique_mapping(inputs, relational.forbidden_originals([(s, "s_name")]), TEST_KEY, "supplier", Pattern("?" * 16))


@query("SELECT count(*) AS n, count(*) AS outputs, 0::BIGINT AS originals, 0::BIGINT AS missing FROM (SELECT DISTINCT s_name FROM supplier)")
def unique_bound_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    width = "#" * max(3, len(str(s.count())))
    m = unique_mapping(
        s.groupBy(F.col("s_name").alias("canonical")).agg(F.min("s_suppkey").alias("rank")), relational.forbidden_originals([(s, "s_name")]), TEST_KEY, "supplier", Pattern(width)
    )
    hits = m.join(s.select(F.col("s_name").alias("output")), "output", "left_semi").count()
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("output").alias("outputs"), F.lit(hits).cast("bigint").alias("originals"), F.count_if(F.col("output").isNull()).alias("missing"))


# -- random replacements ----------------------------------------------------------------------------------------------------


def _random_names(df: DataFrame, seed: bytes) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("__new", random_column(Secret(seed), "customer", "name", Pattern("????####"), F.col("name"), F.col("__row").cast("string"), F.col("__attempt"), False))


@query("SELECT count(*) AS n, count(*) AS outputs, 0::BIGINT AS originals, 0::BIGINT AS failed FROM customer")
def unique_random_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__row"), F.col("c_name").alias("name"))
    draw = _random_names(c, b"query")
    found = redraw_until_unique(c, c, [("name",)], {"name": False}, {"name": "__new"}, draw)
    out = draw(c.join(found, "__row"))
    hits = out.join(c.select(F.col("name").alias("__new")), "__new", "left_semi").count()
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__new").alias("outputs"), F.lit(hits).cast("bigint").alias("originals"), F.count_if("__fails").alias("failed"))


@query("SELECT count(*) AS n, count(*) FILTER (c_nationkey = 0) AS nulls, 0::BIGINT AS failed FROM customer")
def unique_null_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__row"), F.when(F.col("c_nationkey") != 0, F.col("c_name")).alias("name"))
    draw = _random_names(c, b"query")
    found = redraw_until_unique(c, c, [("name",)], {"name": False}, {"name": "__new"}, draw)
    out = draw(c.join(found, "__row"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__new").isNull()).alias("nulls"), F.count_if("__fails").alias("failed"))


@query("SELECT count(DISTINCT c_mktsegment) AS categories, true AS subset, true AS close FROM customer")
def categorical_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    profile = relational.bounded_profile(c, "c_mktsegment")
    total = sum(n for _, n in profile)
    r = F.pmod(F.xxhash64(F.lit(5), "c_custkey"), F.lit(total)) + 1
    sampled = c.select(relational.weighted_pick(r, profile, c.schema["c_mktsegment"].dataType).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("m"))
    known = spark.createDataFrame(profile, "value string, n bigint")
    both = known.join(sampled, "value", "full")
    off = F.abs(F.coalesce("m", F.lit(0)) - F.coalesce("n", F.lit(0))) / total
    return both.agg(F.count(F.lit(1)).alias("categories"), (F.count_if(F.col("n").isNull()) == 0).alias("subset"), (F.max(off) < 0.05).alias("close"))


@query("""WITH p AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT v, sum(n) OVER (ORDER BY n DESC, v) AS upto, n FROM p), t AS (SELECT sum(n) AS total FROM p)
SELECT c_custkey AS id, v AS value FROM customer, t, s WHERE 1 + c_custkey % total > upto - n AND 1 + c_custkey % total <= upto""")
def weighted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    profile = relational.bounded_profile(c, "c_mktsegment")
    r = F.lit(1) + F.col("c_custkey") % sum(n for _, n in profile)
    return c.select(F.col("c_custkey").alias("id"), relational.weighted_pick(r, profile, c.schema["c_mktsegment"].dataType).alias("value"))


# -- runs of the engine ----------------------------------------------------------------------------------------------------


def _customer_engine(spark: SparkSession, sf_dir: str, rules: RuleSet, **columns: dict) -> Engine:
    frames = {"customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders")}
    catalog = SchemaCatalog.of(
        {k: v.schema for k, v in frames.items()}, {"customer": ["c_custkey"], "orders": ["o_orderkey"]}, {"customer": [["c_name"]]},
        [ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",))], {"customer": columns},
    )
    return Engine(spark, EngineConfig(models={"customer": rules}, environment="testing", key=TEST_KEY, run_seed=b"query"), catalog, frames)


@query("SELECT c_custkey, regexp_replace(c_name, '[\\p{N}\\p{L}]', '*', 'g') AS c_name, c_nationkey, 0.0::DOUBLE AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM customer")
def static_overwrite_and_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _customer_engine(spark, sf_dir, RuleSet({"c_name": Expression(lambda c: mask_characters(c, "*")), "c_acctbal": 0.0, "c_mktsegment": None}))
    # masks of equal length collide, so the names are not declared unique here
    engine.catalog = SchemaCatalog.of({"customer": engine.frames["customer"].schema}, {"customer": ["c_custkey"]})
    engine.run()
    return engine.frames["customer"]


@query("SELECT count(*) FILTER (c_mktsegment IS DISTINCT FROM 'BUILDING') AS c_mktsegment, count(*) FILTER (c_acctbal IS DISTINCT FROM 0.0) AS c_acctbal FROM customer")
def changed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumns({"s": F.lit("BUILDING"), "b": F.lit(0.0)})
    return relational.changed_counts(c, [("c_mktsegment", "s"), ("c_acctbal", "b")])


@query("""SELECT code, count(*) AS n FROM (SELECT CASE WHEN c_nationkey = 0 THEN 'not_nullable' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'not_in_allowed_set'
WHEN length(c_mktsegment) > 8 THEN 'too_long' END AS code FROM customer) GROUP BY 1""")
def constraint_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    info = ColumnInfo("c_mktsegment", "string", nullable=False, max_length=8, allowed=("BUILDING", "MACHINERY", "FURNITURE"))
    new = F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment"))
    return c.select(validate.error_of(info, new, c.schema["c_mktsegment"].dataType).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


CUT_SQL = """WITH o AS (SELECT c_custkey, c_mktsegment, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 + 1 AS chunk FROM customer),
f AS (SELECT min(chunk) AS f FROM o WHERE c_custkey = 55)
SELECT c_custkey, CASE WHEN chunk < f THEN 'x' ELSE c_mktsegment END AS c_mktsegment FROM o, f"""


@query(CUT_SQL.replace("c_custkey = 55", "c_custkey = (SELECT quantile_disc(c_custkey, 0.5) FROM customer)"))
def chunk_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    poison = c.agg(F.expr("percentile_disc(0.5) within group (order by c_custkey)")).first()[0]
    catalog = SchemaCatalog.of({"customer": c.schema}, {"customer": ["c_custkey"]}, columns={"customer": {"c_mktsegment": {"max_length": 10}}})
    # one row in the middle gets a value that is too long
    rules = RuleSet({"c_mktsegment": Expression(lambda col: F.when(F.col("c_custkey") == int(poison), F.lit("much too long a value")).otherwise(F.lit("x")))})
    engine = Engine(spark, EngineConfig(models={"customer": rules}, environment="testing"), catalog, {"customer": c})
    engine.run(RunOptions(chunk_size=100))
    return engine.frames["customer"]


@query("""SELECT 'customer' AS target, chunk, count(*) AS n_rows, 'dry_run' AS status FROM (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 400 + 1 AS chunk FROM customer) GROUP BY chunk
UNION ALL SELECT 'orders', chunk, count(*), 'dry_run' FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 + 1 AS chunk FROM orders) GROUP BY chunk""")
def dry_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _customer_engine(spark, sf_dir, RuleSet({"c_mktsegment": "x"}))
    engine.config = EngineConfig(models={"customer": RuleSet({"c_mktsegment": "x"}), "orders": RuleSet({"o_orderpriority": "y"})}, environment="testing")
    return engine.run(RunOptions(chunk_size=400, dry_run=True)).to_df(spark).select("target", "chunk", "n_rows", "status")


@query(f"SELECT c_custkey, c_nationkey, c_acctbal, k.output AS c_name FROM customer JOIN ({_letters_sql('customer', 'c_custkey', 'c_name', 'name', 10)}) k ON c_custkey = k.id")
def undeclared_columns_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _customer_engine(spark, sf_dir, RuleSet({"c_name": keyed_pattern("name", "??????????"), "c_mktsegment": "BUILDING"}, categorical=["c_mktsegment"]))
    engine.run()
    return engine.frames["customer"].select("c_custkey", "c_nationkey", "c_acctbal", "c_name")


@query("SELECT count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)")
def fk_orphans_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("code"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("cust"))
    catalog = SchemaCatalog.of({"c": c.schema, "o": o.schema}, {"c": ["id"], "o": ["id"]}, {"c": [["code"]]}, [ForeignKey("o", ("cust",), "c", ("code",))])
    value = keyed_pattern("cust", "??????")
    config = EngineConfig(models={"c": RuleSet({"code": value}, mirrors={"code": ["o.cust"]}), "o": RuleSet({"cust": value}, mirrors={"cust": ["c.code"]})}, environment="testing", key=TEST_KEY)
    engine = Engine(spark, config, catalog, {"c": c, "o": o})
    engine.run()
    return relational.orphans(engine.frames["o"], ["cust"], engine.frames["c"], ["code"]).agg(F.count(F.lit(1)).alias("n"))


# -- JSON documents ----------------------------------------------------------------------------------------------------


def _rewritten(df: DataFrame, key: str, text: str, paths: JsonPaths, replace: jsondoc.Replace) -> DataFrame:
    done = jsondoc.rewrite_column(paths, replace, F.col(text), F.lit(None).cast("map<string,string>"), F.lit(""))
    return df.select(F.col(key).alias("id"), done["value"].alias("doc"))


def _constant(value: object) -> jsondoc.Replace:
    return lambda path, leaf, mapping, identity: value


@query("""SELECT event_id AS id, '{"k":"REDACTED"}' AS doc FROM events""")
def json_static_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(table(spark, sf_dir, "events"), "event_id", "props", JsonPaths({"k": "REDACTED"}), _constant("REDACTED"))


@query("SELECT event_id AS id, props AS doc FROM events")
def json_missing_path_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(table(spark, sf_dir, "events"), "event_id", "props", JsonPaths({"x->y": 1}), _constant(1))


@query("""SELECT conv_id AS id, '{"turns":[' || string_agg('{"turn":' || turn || ',"text":"-"}', ',' ORDER BY turn) || ']}' AS doc FROM conversations GROUP BY conv_id""")
def json_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("doc"))
    return _rewritten(docs, "conv_id", "doc", JsonPaths({"turns->*->text": "-"}), _constant("-"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '{"a":"-","b":[],"c":{}}' WHEN 1 THEN '{ "a" : null }' ELSE '{"b":1.0}' END AS doc FROM customer""")
def json_null_and_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    doc = F.when(kind == 0, F.concat(F.lit('{"a": '), "c_custkey", F.lit(', "b": [], "c": {}}'))).when(kind == 1, '{ "a" : null }').otherwise('{"b":1.0}')
    return _rewritten(table(spark, sf_dir, "customer").withColumn("doc", doc), "c_custkey", "doc", JsonPaths({"a": "-"}), _constant("-"))


@query("SELECT (SELECT count(*) FROM events WHERE json_valid(props)) AS props, (SELECT count(*) FROM pages WHERE json_valid(html)) AS html")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def valid(name: str, c: str) -> int:
        return table(spark, sf_dir, name).where(validate.is_valid_json(F.col(c))).count()

    return one_row(spark, props=F.lit(valid("events", "props")).cast("bigint"), html=F.lit(valid("pages", "html")).cast("bigint"))


NAME_SQL = keyed_sql(
    "customer", "c_custkey", "c_name", "name", 10,
    f"SELECT id, string_agg(CASE WHEN i <= 3 THEN {LETTER_SQL} WHEN i = 4 THEN '-' || (r % 10)::VARCHAR ELSE (r % 10)::VARCHAR END, '' ORDER BY i) AS output FROM d GROUP BY id",
)
SEGMENT_SQL = _kept_sql("customer", "c_custkey", "c_mktsegment", "segment", "p > n - 4", 12)


@query(f"SELECT c_custkey, n.output AS c_name, c_nationkey, c_acctbal, s.output AS c_mktsegment FROM customer JOIN ({NAME_SQL}) n ON c_custkey = n.id LEFT JOIN ({SEGMENT_SQL}) s ON c_custkey = s.id")
def sanitized_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: keyed names that stay unique, keyed segments of the same form, all else unchanged."""
    engine = _customer_engine(spark, sf_dir, RuleSet({"c_name": keyed_pattern("name", "???-#######"), "c_mktsegment": keyed("segment", shapes.KeepLast(4))}))
    engine.run()
    return engine.frames["customer"]


@query("""SELECT o_orderkey AS id, array_agg('-') AS words, o_custkey AS number FROM (SELECT o_orderkey, o_custkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders) GROUP BY 1, 3""")
def json_array_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into a column of arrays and one of structs, which come back as what they were."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.split("o_orderpriority", "-").alias("words"), F.struct(F.col("o_custkey").alias("number"), F.col("o_orderpriority").alias("text")).alias("who"),
    )
    catalog = SchemaCatalog.of({"o": o.schema}, {"o": ["id"]})
    rules = RuleSet({"words": JsonPaths({"*": "-"}), "who": JsonPaths({"text": "gone"})})
    engine = Engine(spark, EngineConfig(models={"o": rules}, environment="testing"), catalog, {"o": o})
    engine.run()
    return engine.frames["o"].where("who.text = 'gone'").select("id", "words", "who.number")


@query("""WITH o AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 + 1 AS chunk FROM customer),
f AS (SELECT min(chunk) AS f FROM o WHERE c_custkey % 777 = 776)
SELECT chunk, count(*) AS n_rows, CASE WHEN chunk = f THEN 'rolled_back' ELSE 'committed' END AS status, CASE WHEN chunk = f THEN 'c_name: the expression fails (message withheld)' END AS error
FROM o, f WHERE f IS NULL OR chunk <= f GROUP BY chunk, f""")
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression that fails for some rows: the first chunk that has one is the last one attempted, and its message isn't shown."""
    fails = Expression(lambda c: F.when(F.col("c_custkey") % 777 == 776, F.raise_error(c)).otherwise(F.lit("x")))
    c = table(spark, sf_dir, "customer")
    engine = Engine(spark, EngineConfig(models={"customer": RuleSet({"c_name": fails})}, environment="testing"), SchemaCatalog.of({"customer": c.schema}, {"customer": ["c_custkey"]}), {"customer": c})
    return engine.run(RunOptions(chunk_size=100)).to_df(spark).select("chunk", "n_rows", "status", "error")
