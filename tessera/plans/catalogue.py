"""The queries of the relational engine, with the SQL that each is compared with.

A query is dialect text for the engine, with names for its columns (the dialect has no aliases), or a function for what
needs a folder, a transaction or a log.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.operators import logreplay
from tessera.store import tables
from tessera.store.locks import LockTable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def open_engine(spark: SparkSession, sf_dir: str, folder: bool = False) -> Engine:
    """An engine with the tables registered; with a new folder of its own, where the cluster shares one, if asked."""
    root = None
    if folder:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not shared:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise EngineError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tessera-")
        root = f"{shared}/engine-{uuid.uuid4().hex}"
    engine = Engine(spark, root)
    for name in TABLES:
        engine.register(name, f"{sf_dir}/{name}.parquet")
    return engine


def dialect(sql: str, *names: str, strategy: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = open_engine(spark, sf_dir).execute(sql, strategy)
        return found.toDF(*names) if names else found

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = open_engine(spark, sf_dir)
    # The filter reads the stored column, so that it is pushed to the scan; only the sum is of decimals.
    engine.register("lineitem", engine.read("lineitem").withColumn("q_exact", F.col("l_quantity").cast("decimal(18,2)")))
    found = engine.execute(
        "SELECT l_returnflag, COUNT(*), SUM(q_exact), AVG(l_discount), MIN(o_orderkey), MAX(o_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "WHERE o_totalprice > 1000 AND l_quantity < 30 GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 10"
    ).toDF("l_returnflag", "n", "q", "d", "mn", "mx")
    return found.select("l_returnflag", "n", F.col("q").cast("double").alias("q"), F.round("d", 4).alias("d"), "mn", "mx")


def _decimals(engine: Engine, table: str, *columns: str) -> None:
    """Money and quantities as decimals, whose sums do not depend on the order of addition."""
    engine.register(table, engine.read(table).withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns}))


def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = open_engine(spark, sf_dir)
    _decimals(engine, "lineitem", "l_extendedprice")
    found = engine.execute("SELECT COUNT(*), COUNT(l_tax), SUM(l_extendedprice), AVG(l_quantity), MIN(l_discount), MAX(l_shipdate) FROM lineitem").toDF("n", "nt", "s", "a", "mn", "mx")
    return found.select("n", "nt", F.col("s").cast("double").alias("s"), F.round("a", 4).alias("a"), "mn", "mx")


def nullable(sql: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """The statement over orders whose status F is unknown (column st)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = open_engine(spark, sf_dir)
        engine.register("t", engine.read("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("st")))
        return engine.execute(sql).toDF(*names)

    return run


def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_engine(spark, sf_dir).execute("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON TRUE")


def layout(table: str, column: str, predicate: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A lookup in files laid out by the key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = open_engine(spark, sf_dir, folder=True)
        engine.create_index(table, column)
        found = engine.lookup(table, predicate)
        return found.select(*columns) if columns else found

    return run


def script(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """Statements in an engine with a folder; the last one's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = open_engine(spark, sf_dir, folder=True)
        for s in statements[:-1]:
            engine.execute(s)
        return engine.execute(statements[-1])

    return run


def _copied(spark: SparkSession, sf_dir: str, table: str) -> Engine:
    """An engine whose folder has a table with the rows of a registered one."""
    engine = open_engine(spark, sf_dir, folder=True)
    rows = engine.read(table)
    del engine.views[table]
    kinds = {"int": "INT", "bigint": "INT", "string": "VARCHAR(200)", "double": "FLOAT"}
    engine.execute(f"CREATE TABLE {table} ({', '.join(f'{f.name} {kinds[f.dataType.simpleString()]}' + (' PRIMARY KEY' if k == 0 else '') for k, f in enumerate(rows.schema.fields))})")
    engine.append(table, rows)
    return engine


def on_copy(table: str, *statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _copied(spark, sf_dir, table)
        for s in statements:
            engine.execute(s)
        return engine.execute(f"SELECT * FROM {table}")

    return run


def mvcc_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("k"), (key % 10 + 1).alias("created"), F.when(key % 3 == 0, key % 10 + 3).otherwise(0).alias("deleted"))
    return logreplay.visible(rows, 6).select("k")


def mvcc_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "nation")
    engine.execute("DELETE FROM nation WHERE n_regionkey = 2")
    engine.vacuum("nation")
    return engine.execute("SELECT * FROM nation")


def _status(spark: SparkSession, work: Callable[[], object]) -> DataFrame:
    try:
        work()
        name = "OK"
    except EngineError as e:
        name = e.status.name
    return spark.createDataFrame([(name,)], "status string")


def txn_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "region")
    one, two = engine.session(), engine.session()
    for s in (one, two):
        s.begin()
        s.execute("DELETE FROM region WHERE r_regionkey = 1")
    one.commit()
    return _status(spark, two.commit)


def deadlock_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks = LockTable()
    locks.acquire(1, "orders", "X")
    locks.acquire(2, "lineitem", "X")
    locks.wait_for(1, {2})
    return _status(spark, lambda: locks.acquire(2, "orders", "X"))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: a transaction for each remainder of the id by 4, of which 0 never commits."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    data = events.select(F.col("event_id").alias("lsn"), (F.col("event_id") % 4).alias("txn"), kind.alias("kind"), F.col("user_id").alias("rid"), F.col("event_id").alias("val"))
    ends = spark.range(1, 4).select(F.lit((1 << 62)).alias("lsn"), F.col("id").alias("txn"), F.lit("COMMIT").alias("kind"), F.lit(None).cast("long").alias("rid"), F.lit(None).cast("long").alias("val"))
    return data.union(ends)


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = open_engine(spark, sf_dir)
    engine.views = {k: v for k, v in engine.views.items() if k in ("nation", "region")}
    return engine.list_tables()


def catalog_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("orders", open_engine(spark, sf_dir).analyze("orders"))], "table_name string, n long")


def catalog_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = open_engine(spark, sf_dir, folder=True)
    for table, column in (("nation", "n_regionkey"), ("orders", "o_custkey"), ("orders", "o_orderkey"), ("region", "r_regionkey")):
        engine.create_index(table, column)
    engine.drop_index("region")
    return engine.list_indexes()


def index_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = open_engine(spark, sf_dir, folder=True)
    engine.create_index("nation", "n_regionkey")
    engine.drop_index("nation")
    return engine.lookup("nation", "n_regionkey = 2").select("n_nationkey")


def failed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that does not fit is a status; nothing of its statement stays, and the table can be written on."""
    engine = _copied(spark, sf_dir, "region")
    codes = [engine.execute_update(s).name for s in ("INSERT INTO region VALUES (3000000000, 'x')", "DELETE FROM region WHERE 1 / (r_regionkey - r_regionkey) > 0", "INSERT INTO region VALUES (9, 'y')")]
    rows = engine.execute("SELECT COUNT(*) FROM region").first()[0]
    return spark.createDataFrame([(*codes, len(engine.active_transactions()), rows)], "overflow string, division string, insert_ string, open_ int, n long")


def catalog_cardinality_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "nation")
    before = engine.cardinality("nation")
    engine.execute("DELETE FROM nation WHERE n_regionkey = 2")
    return spark.createDataFrame([("nation", before, engine.cardinality("nation"))], "table_name string, n long, after_ long")


def checkpoint_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough commits for a checkpoint, then a read of what it and the entries since say."""
    engine = _copied(spark, sf_dir, "region")
    for k in range(tables.CHECKPOINT_EVERY):
        engine.execute(f"DELETE FROM region WHERE r_regionkey = {k}") if k < 3 else engine.execute(f"CREATE TABLE t{k} (a INT)")
    again = Engine(spark, engine.store.files.root)
    return again.execute("SELECT * FROM region").withColumn("checkpoints", F.lit(len(again.store.log.checkpoints()) > 0))


def catalog_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "region")
    return Engine(spark, engine.store.files.root).execute("SELECT * FROM region")


def recovery_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "nation")
    engine.execute("DELETE FROM nation WHERE n_regionkey = 2")
    lost = engine.session()
    lost.begin()
    lost.execute("DELETE FROM nation WHERE n_regionkey = 1")
    return Engine(spark, engine.store.files.root).execute("SELECT * FROM nation")


def script_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.NamedTemporaryFile("w", suffix=".sql") as f:
        f.write("CREATE TABLE t (id INT, v VARCHAR(10)); -- two rows; with marks in strings\nINSERT INTO t VALUES (1, 'a;b'), (2, 'c--d');\nSELECT * FROM t;")
        f.flush()
        return open_engine(spark, sf_dir, folder=True).run_script(f.name)[0]


_DIALECT: dict[str, tuple[str, ...]] = {
    "seq_scan": ("SELECT * FROM nation",),
    "project_columns": ("SELECT n_name, n_regionkey FROM nation",),
    "project_qualified": ("SELECT customer.c_name, customer.c_acctbal FROM customer",),
    "project_table_star": ("SELECT region.* FROM region",),
    "project_arith": ("SELECT l_orderkey, l_linenumber, l_quantity + 1, l_quantity - 1, l_quantity * 2, l_quantity / 4, l_linenumber % 3, -l_quantity FROM lineitem", "l_orderkey", "l_linenumber", "q_add", "q_sub", "q_mul", "q_div", "ln_mod", "q_neg"),
    "filter_eq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",),
    "filter_neq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",),
    "filter_lt_le": ("SELECT p_partkey, p_size FROM part WHERE p_size < 10 OR p_size <= 12",),
    "filter_gt_ge": ("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size >= 12",),
    "filter_precedence": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_returnflag = 'A' AND (l_quantity > 40 OR l_discount < 0.02)",),
    "filter_col_col": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber",),
    "filter_arith": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber * 2 + 1 > 9",),
    "filter_negative_literal": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -100",),
    "filter_string_range": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment >= 'H'",),
    "filter_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 10000 AND 50000",),
    "filter_truthy_number": ("SELECT n_nationkey FROM nation WHERE n_regionkey",),
    "filter_bool_literal": ("SELECT r_name FROM region WHERE TRUE",),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",),
    "order_asc_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10",),
    "order_desc_all_keys": ("SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey, c_custkey DESC LIMIT 25",),
    "limit_zero": ("SELECT r_name FROM region LIMIT 0",),
    "join_equi": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",),
    "join_theta": ("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey",),
    "join_neq": ("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey <> r_regionkey",),
    "join_pushdown": ("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice < 50000 AND l_quantity > 10 AND o_orderdate < l_shipdate",),
    "agg_group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_linenumber) FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag", "l_linestatus", "n", "s"),
    "agg_group_expr": ("SELECT p_size % 5, COUNT(*) FROM part GROUP BY p_size % 5", "k", "n"),
    "agg_empty": ("SELECT COUNT(*), SUM(p_size), MIN(p_size) FROM part WHERE p_size < 0", "n", "s", "mn"),
    "agg_over_join": ("SELECT r_name, COUNT(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY r_name", "r_name", "n"),
    "agg_events": ("SELECT event_type, COUNT(*), MIN(ts), MAX(value) FROM events GROUP BY event_type", "event_type", "n", "first_ts", "max_value"),
    "bench_point": ("SELECT * FROM orders WHERE o_orderkey = 77",),
    "bench_join": ("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice < 100000",),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: dialect(*text) for name, text in _DIALECT.items()}
    return {"flagship": flagship} | made | {
        "filter_is_null": nullable("SELECT o_orderkey FROM t WHERE st IS NULL", "o_orderkey"),
        "filter_is_not_null": nullable("SELECT o_orderkey, st FROM t WHERE st IS NOT NULL", "o_orderkey", "st"),
        "filter_null_compare": nullable("SELECT o_orderkey FROM t WHERE NOT st = 'O'", "o_orderkey"),
        "join_hash_forced": dialect("SELECT o_orderkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey", strategy="shuffle_hash"),
        "join_cross": join_cross,
        "agg_global": agg_global,
        "agg_count_nulls": nullable("SELECT COUNT(*), COUNT(st) FROM t", "n", "nn"),
        "index_point": layout("orders", "o_orderkey", "o_orderkey = 42", "o_orderkey", "o_totalprice"),
        "index_range": layout("orders", "o_orderkey", "o_orderkey >= 100 AND o_orderkey <= 200", "o_orderkey"),
        "pk_lookup": layout("customer", "c_custkey", "c_custkey = 7", "c_custkey", "c_name"),
        "insert_values": script("CREATE TABLE people (id INT PRIMARY KEY, name VARCHAR(20), age INT)", "INSERT INTO people VALUES (1, 'alice', 30), (2, 'bob', 41)", "SELECT * FROM people"),
        "insert_column_list": script("CREATE TABLE people (id INT PRIMARY KEY, name VARCHAR(20), age INT)", "INSERT INTO people (name, id) VALUES ('x', 1), ('y', 2)", "SELECT * FROM people"),
        "insert_truncate": script("CREATE TABLE long (id INT, v VARCHAR(3))", "INSERT INTO long VALUES (1, 'abcdef')", "SELECT * FROM long"),
        "delete_where": on_copy("nation", "DELETE FROM nation WHERE n_regionkey = 2"),
        "delete_duplicates": script("CREATE TABLE dups (k INT, v VARCHAR(3))", "INSERT INTO dups VALUES (1, 'a'), (1, 'b')", "DELETE FROM dups WHERE v = 'b'", "SELECT * FROM dups"),
        "delete_all": on_copy("region", "DELETE FROM region"),
        "drop_if_exists": drop_if_exists,
        "txn_commit": on_copy("region", "BEGIN", "DELETE FROM region WHERE r_regionkey = 0", "COMMIT"),
        "txn_rollback": on_copy("region", "BEGIN", "DELETE FROM region WHERE r_regionkey = 0", "ROLLBACK"),
        "mvcc_visible": mvcc_visible,
        "mvcc_vacuum": mvcc_vacuum,
        "txn_conflict": txn_conflict,
        "deadlock_cycle": deadlock_cycle,
        "recovery_redo": lambda spark, d: logreplay.redo(_event_log(spark, d)),
        "recovery_losers": lambda spark, d: logreplay.undo(_event_log(spark, d)),
        "catalog_tables": catalog_tables,
        "catalog_schema": lambda spark, d: open_engine(spark, d).table_schema("region"),
        "catalog_cardinality": catalog_cardinality,
        "catalog_cardinality_kept": catalog_cardinality_kept,
        "catalog_indexes": catalog_indexes,
        "index_dropped": index_dropped,
        "failed_insert": failed_insert,
        "checkpoint_written": checkpoint_written,
        "catalog_reload": catalog_reload,
        "script_run": script_run,
        "recovery_reopen": recovery_reopen,
    }


def drop_if_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = open_engine(spark, sf_dir, folder=True)
    engine.views = {}
    for s in ("CREATE TABLE kept (a INT)", "CREATE TABLE gone (a INT)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone"):
        engine.execute(s)
    return engine.list_tables()


#: What each query must equal, as SQL over the same tables.
_SQL = {
    "flagship": 'SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, ROUND(AVG(l_discount), 4) AS d, MIN(o_orderkey) AS mn, MAX(o_orderkey) AS mx FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 AND l_quantity < 30 GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 10',
    "seq_scan": 'SELECT * FROM nation',
    "project_columns": 'SELECT n_name, n_regionkey FROM nation',
    "project_qualified": 'SELECT customer.c_name, customer.c_acctbal FROM customer',
    "project_table_star": 'SELECT region.* FROM region',
    "project_arith": 'SELECT l_orderkey, l_linenumber, l_quantity + 1 AS q_add, l_quantity - 1 AS q_sub, l_quantity * 2 AS q_mul, l_quantity / 4 AS q_div, l_linenumber % 3 AS ln_mod, -l_quantity AS q_neg FROM lineitem',
    "filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_neq": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_lt_le": 'SELECT p_partkey, p_size FROM part WHERE p_size < 10 OR p_size <= 12',
    "filter_gt_ge": 'SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size >= 12',
    "filter_precedence": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_returnflag = 'A' AND (l_quantity > 40 OR l_discount < 0.02)",
    "filter_col_col": 'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber',
    "filter_arith": 'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber * 2 + 1 > 9',
    "filter_negative_literal": 'SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -100',
    "filter_string_range": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment >= 'H'",
    "filter_between": 'SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 10000 AND 50000',
    "filter_is_null": "SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders) t WHERE st IS NULL",
    "filter_is_not_null": "SELECT o_orderkey, st FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders) t WHERE st IS NOT NULL",
    "filter_null_compare": "SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders) t WHERE NOT st = 'O'",
    "filter_truthy_number": 'SELECT n_nationkey FROM nation WHERE n_regionkey <> 0',
    "filter_bool_literal": 'SELECT r_name FROM region WHERE TRUE',
    "distinct": 'SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem',
    "order_asc_limit": 'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10',
    "order_desc_all_keys": 'SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_custkey DESC LIMIT 25',
    "limit_zero": 'SELECT r_name FROM region LIMIT 0',
    "join_equi": 'SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey',
    "join_theta": 'SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey',
    "join_neq": 'SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey <> r_regionkey',
    "join_hash_forced": 'SELECT o_orderkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey',
    "join_cross": 'SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region',
    "join_pushdown": 'SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice < 50000 AND l_quantity > 10 AND o_orderdate < l_shipdate',
    "agg_global": 'SELECT COUNT(*) AS n, COUNT(l_tax) AS nt, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s, ROUND(AVG(l_quantity), 4) AS a, MIN(l_discount) AS mn, MAX(l_shipdate) AS mx FROM lineitem',
    "agg_group_multi": 'SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus',
    "agg_group_expr": 'SELECT p_size % 5 AS k, COUNT(*) AS n FROM part GROUP BY p_size % 5',
    "agg_count_nulls": "SELECT COUNT(*) AS n, COUNT(st) AS nn FROM (SELECT NULLIF(o_orderstatus, 'F') AS st FROM orders) t",
    "agg_empty": 'SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_size) AS mn FROM part WHERE p_size < 0',
    "agg_over_join": 'SELECT r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name',
    "agg_events": 'SELECT event_type, COUNT(*) AS n, MIN(ts) AS first_ts, MAX(value) AS max_value FROM events GROUP BY event_type',
    "index_point": 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42',
    "index_range": 'SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200',
    "insert_values": "SELECT * FROM (VALUES (1, 'alice', 30), (2, 'bob', 41)) t(id, name, age)",
    "insert_column_list": "SELECT * FROM (VALUES (1, 'x', CAST(NULL AS INT)), (2, 'y', CAST(NULL AS INT))) t(id, name, age)",
    "insert_truncate": "SELECT * FROM (VALUES (1, 'abc')) t(id, v)",
    "delete_where": 'SELECT * FROM nation WHERE NOT (n_regionkey = 2)',
    "delete_duplicates": "SELECT * FROM (VALUES (1, 'a')) t(k, v)",
    "delete_all": 'SELECT * FROM region WHERE FALSE',
    "drop_if_exists": "SELECT 'kept' AS table_name",
    "txn_commit": 'SELECT * FROM region WHERE r_regionkey <> 0',
    "txn_rollback": 'SELECT * FROM region',
    "mvcc_visible": 'SELECT k FROM (SELECT o_orderkey AS k, o_orderkey % 10 + 1 AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 + 3 ELSE 0 END AS d FROM orders) t WHERE c <= 6 AND (d = 0 OR d > 6)',
    "mvcc_vacuum": 'SELECT * FROM nation WHERE n_regionkey <> 2',
    "txn_conflict": "SELECT 'TXN_CONFLICT' AS status",
    "deadlock_cycle": "SELECT 'DEADLOCK' AS status",
    "recovery_redo": "SELECT rid, val FROM (SELECT user_id AS rid, event_id AS val, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 4 <> 0) t WHERE rn = 1 AND event_type <> 'error'",
    "recovery_losers": 'SELECT event_id % 4 AS txn, COUNT(*) AS undone FROM events WHERE event_id % 4 = 0 GROUP BY event_id % 4',
    "catalog_tables": "SELECT table_name FROM (VALUES ('nation'), ('region')) t(table_name)",
    "catalog_schema": "SELECT * FROM (VALUES ('region', 'r_regionkey', 'INT', FALSE), ('region', 'r_name', 'VARCHAR', FALSE)) t(table_name, column_name, type_name, is_pk)",
    "catalog_cardinality": "SELECT 'orders' AS table_name, COUNT(*) AS n FROM orders",
    "catalog_reload": 'SELECT * FROM region',
    "catalog_cardinality_kept": "SELECT 'nation' AS table_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE n_regionkey <> 2) AS after_ FROM nation",
    "catalog_indexes": "SELECT * FROM (VALUES ('nation', 'n_regionkey'), ('orders', 'o_orderkey')) t(table_name, column_name)",
    "index_dropped": 'SELECT n_nationkey FROM nation WHERE n_regionkey = 2',
    "failed_insert": "SELECT 'INVALID_ARGUMENT' AS overflow, 'INVALID_ARGUMENT' AS division, 'OK' AS insert_, 0 AS open_, COUNT(*) + 1 AS n FROM region",
    "checkpoint_written": 'SELECT *, TRUE AS checkpoints FROM region WHERE r_regionkey >= 3',
    "script_run": "SELECT * FROM (VALUES (1, 'a;b'), (2, 'c--d')) t(id, v)",
    "pk_lookup": 'SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7',
    "recovery_reopen": 'SELECT * FROM nation WHERE n_regionkey <> 2',
    "bench_point": 'SELECT * FROM orders WHERE o_orderkey = 77',
    "bench_join": 'SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice < 100000',
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
