import pytest

from tessera import cli
from tessera.engine import Engine
from tessera.errors import Deadlock, DuplicateKey, EngineError, NotFound, ParseError, Status, TxnConflict, TypeMismatch
from tessera.store.locks import LockTable


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture
def people(engine):
    engine.execute("CREATE TABLE people (id INT PRIMARY KEY, name VARCHAR(8) NOT NULL, age INT, score FLOAT, ok BOOL)")
    engine.execute("INSERT INTO people VALUES (1, 'ann', 30, 1.5, TRUE), (2, 'bob', NULL, NULL, NULL), (3, 'cy', 41, 2, FALSE)")
    return engine


def test_nulls_have_three_values(people):
    ask = lambda where: [r[0] for r in rows(people.execute(f"SELECT id FROM people WHERE {where}"))]
    assert ask("age = 30") == [1]
    assert ask("NOT age = 30") == [3]
    assert ask("age IS NULL") == [2]
    assert ask("ok") == [1]
    assert ask("NOT ok") == [3]
    assert ask("name AND age") == [1, 3]
    assert ask("age = NULL") == []
    assert ask("ok IS NOT NULL OR age < 0") == [1, 3]
    assert rows(people.execute("SELECT COUNT(*), COUNT(age), SUM(age), MIN(name), MAX(score) FROM people")) == [(3, 2, 71, "ann", 2.0)]


def test_projection_expressions_are_named_by_their_text(people):
    df = people.execute("SELECT people.id, age + 1, MAX(score) FROM people GROUP BY id, age ORDER BY id LIMIT 1")
    assert df.columns == ["id", "(age + 1)", "MAX(score)"]
    assert rows(df) == [(1, 31, 1.5)]


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT a FROM people", EngineError), ("SELECT id FROM nobody", NotFound), ("SELECT id FROM people WHERE name = 1", TypeMismatch), ("SELECT name + 1 FROM people", TypeMismatch),
        ("SELECT LOWER(name) FROM people", EngineError), ("SELECT id, COUNT(*) FROM people", EngineError), ("SELECT SUM(name) FROM people", TypeMismatch), ("SELECT id FROM people WHERE COUNT(*) > 1", EngineError),
        ("SELECT Id FROM people", EngineError), ("INSERT INTO people VALUES (1, 'x', 1, 1.0, TRUE)", DuplicateKey), ("INSERT INTO people (id) VALUES (9)", EngineError), ("INSERT INTO people VALUES (8, 'x')", EngineError),
        ("INSERT INTO people VALUES (8, 9, 1, 1.0, TRUE)", TypeMismatch), ("INSERT INTO people (id, name) VALUES (7, 'a'), (7, 'b')", DuplicateKey), ("CREATE TABLE people (a INT)", EngineError), ("DROP TABLE nobody", NotFound),
        ("SELECT id FROM people WHERE x.id = 1", NotFound), ("SELECT id FROM people JOIN people ON id = id", EngineError), ("SELECT DISTINCT name FROM people ORDER BY id", EngineError), ("SELECT id FROM people x", ParseError),
    ],
)
def test_errors_are_raised(people, sql, error):
    with pytest.raises(error):
        people.execute(sql)
    assert people.execute("SELECT id FROM people").count() == 3


def test_statuses(people):
    assert people.execute_update("INSERT INTO people VALUES (1, 'x', 1, 1.0, TRUE)") is Status.DUPLICATE_KEY
    assert people.execute_update("CREATE TABLE IF NOT EXISTS people (a INT)") is Status.OK
    assert people.execute_update("DROP TABLE IF EXISTS nobody") is Status.OK
    assert people.execute_update("DROP TABLE nobody") is Status.NOT_FOUND
    assert people.execute_update("DELETE people") is Status.INVALID_ARGUMENT
    assert people.execute_update("SELECT LOWER(name) FROM people") is Status.INVALID_ARGUMENT


def test_delete_removes_the_rows_that_match_and_no_others(engine):
    engine.execute("CREATE TABLE dups (k INT, v VARCHAR(3))")
    engine.execute("INSERT INTO dups VALUES (1, 'a'), (1, 'b'), (1, 'a'), (2, NULL)")
    engine.execute("DELETE FROM dups WHERE v = 'a' AND k = 1")
    assert rows(engine.execute("SELECT * FROM dups")) == [(1, "b"), (2, None)]
    engine.execute("DELETE FROM dups WHERE v = 'zz'")
    engine.execute("DELETE FROM dups")
    assert rows(engine.execute("SELECT * FROM dups")) == []


def test_insert_coerces_truncates_and_checks_range(engine):
    engine.execute("CREATE TABLE t (i INT, f FLOAT, v VARCHAR(3))")
    engine.execute("INSERT INTO t VALUES (2 + 1, 4, 'abcdef')")
    assert rows(engine.execute("SELECT * FROM t")) == [(3, 4.0, "abc")]
    with pytest.raises(Exception, match="(?i)overflow|range"):
        engine.execute("INSERT INTO t VALUES (3000000000, 1.0, 'x')")


def test_transactions_see_their_snapshot_and_their_own_writes(people):
    other = people.session()
    other.begin()
    people.execute("INSERT INTO people (id, name) VALUES (4, 'di')")
    assert other.execute("SELECT id FROM people").count() == 3
    other.execute("INSERT INTO people (id, name) VALUES (5, 'ed')")
    assert other.execute("SELECT id FROM people").count() == 4
    assert people.execute("SELECT id FROM people").count() == 4
    assert people.active_transactions() == [other.txn.id]
    other.commit()
    assert people.execute("SELECT id FROM people").count() == 5
    people.execute("BEGIN")
    people.execute("DELETE FROM people")
    people.execute("CREATE TABLE more (a INT)")
    people.execute("ROLLBACK")
    assert people.execute("SELECT id FROM people").count() == 5
    with pytest.raises(NotFound):
        people.read("more")
    people.execute("COMMIT")  # with nothing open, nothing happens
    people.execute("ROLLBACK")


def test_first_committer_wins(people):
    one, two, three = people.session(), people.session(), people.session()
    for s, key in ((one, 1), (two, 1), (three, 2)):
        s.begin()
        s.execute(f"DELETE FROM people WHERE id = {key}")
    one.commit()
    with pytest.raises(TxnConflict):
        two.commit()
    three.commit()
    assert rows(people.execute("SELECT id FROM people")) == [(3,)]
    one.begin()
    two.begin()
    for s in (one, two):
        s.execute("INSERT INTO people (id, name) VALUES (9, 'x')")
    one.commit()
    with pytest.raises(DuplicateKey):
        two.commit()


def test_retry_runs_again_after_a_conflict(people):
    tries = []

    def work(session):
        tries.append(1)
        session.execute("DELETE FROM people WHERE id = 1")
        if len(tries) == 1:
            people.execute("DELETE FROM people WHERE id = 1")

    people.session().retry(work)
    assert len(tries) == 2
    assert people.execute("SELECT id FROM people").count() == 2


def test_serializable_sessions_lock(people):
    one, two = people.session("serializable"), people.session("serializable")
    one.begin()
    two.begin()
    one.execute("SELECT id FROM people")
    two.execute("SELECT id FROM people")
    with pytest.raises(TxnConflict):
        one.execute("DELETE FROM people WHERE id = 1")
    two.rollback()
    one.execute("DELETE FROM people WHERE id = 1")
    one.commit()
    assert people.execute("SELECT id FROM people").count() == 2


def test_locks():
    locks = LockTable()
    locks.acquire(1, "a", "S")
    locks.acquire(2, "a", "S")
    with pytest.raises(TxnConflict):
        locks.acquire(1, "a", "X")
    locks.release(2)
    locks.acquire(1, "a", "X")
    assert locks.holders("a") == {1: "X"}
    locks.acquire(2, "b", "X")
    locks.wait_for(1, {2})
    assert locks.cycle() == []
    with pytest.raises(Deadlock):
        locks.acquire(2, "a", "S")
    locks.release(1)
    locks.acquire(2, "a", "S")


def test_reopen_recovers(spark, people):
    root = people.store.files.root
    lost = people.session()
    lost.begin()
    lost.execute("INSERT INTO people (id, name) VALUES (6, 'lost')")
    assert Engine(spark, root).recovered["undone"] == []
    again = Engine(spark, root, grace=0)
    assert len(again.recovered["undone"]) == 1
    assert again.execute("SELECT id FROM people").count() == 3
    last = again.store.log.last()
    again.store.files._fs.create(again.store.files._path(f"log/{last + 1:020d}.json"), True).close()  # a torn entry
    third = Engine(spark, root, grace=0)
    assert third.recovered["torn"] == [last + 1]
    third.execute("INSERT INTO people (id, name) VALUES (7, 'new')")
    assert third.store.snapshot("people", version=last).count() == 3
    assert third.execute("SELECT id FROM people").count() == 4


def test_vacuum_keeps_the_rows_and_drops_old_files(people):
    people.execute("DELETE FROM people WHERE id = 1")
    before = rows(people.execute("SELECT * FROM people"))
    assert people.vacuum()
    assert rows(people.execute("SELECT * FROM people")) == before
    assert people.store.log.checkpoints()
    assert not people.store.table("people").removed


def test_index_layout_is_pushed_down(spark, engine, sf):
    engine.register("orders", f"{sf}/orders.parquet")
    engine.create_index("orders", "o_orderkey")
    df = engine.lookup("orders", "o_orderkey = 42")
    assert "EqualTo(o_orderkey,42)" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey = 42").count()


@pytest.mark.parametrize(("strategy", "node"), [("broadcast_hash", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("sort_merge", "SortMergeJoin"), ("nested_loop", "CartesianProduct")])
def test_join_strategies(engine, sf, strategy, node):
    for t in ("nation", "region"):
        engine.register(t, f"{sf}/{t}.parquet")
    sql = "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
    assert node in engine.explain(sql, strategy)
    assert rows(engine.execute(sql, strategy)) == rows(engine.execute(sql))


def test_catalog(people):
    assert [tuple(r) for r in people.list_tables().collect()] == [("people",)]
    assert [r["column_name"] for r in people.table_schema("people").collect() if r["is_pk"]] == ["id"]
    assert people.cardinality("people") == 3
    people.set_cardinality("people", 7)
    assert people.cardinality("people") == 7


def test_command_line(people, tmp_path):
    said = []
    cli.repl(people, ["SELECT id, name,\n", " score, ok FROM people ORDER BY id LIMIT 2; -- two\n", ";\n", ".tables\n", ".schema\n", ".what\n", ".help\n", "SELECT nope FROM people;\n", "INSERT INTO people (id, name)\n", "VALUES (8, 'a;b');\n", ".quit\n", "never\n"], said.append)
    assert said[:3] == ["1, 'ann', 1.500000, true", "2, 'bob', NULL, NULL", "(2 rows)"]
    assert "people" in said
    assert "people(id INT PRIMARY KEY, name VARCHAR(8), age INT, score FLOAT, ok BOOL);" in said
    assert any(s.startswith("Status: INVALID_ARGUMENT") for s in said)
    assert said[-1] == "OK"
    script = tmp_path / "s.sql"
    script.write_text("CREATE TABLE s (v VARCHAR(9)); INSERT INTO s VALUES ('a;b'), ('c--d'); SELECT * FROM s")
    assert rows(people.run_script(str(script))[0]) == [("a;b",), ("c--d",)]


def test_directions_for_each_key(people):
    found = people.execute("SELECT ok, id FROM people ORDER BY ok, id", directions=[False, True]).collect()
    assert [r["id"] for r in found] == [2, 3, 1]


def test_opening_and_vacuuming_leave_live_writers_alone(spark, people):
    writer = people.session()
    writer.begin()
    writer.execute("INSERT INTO people (id, name) VALUES (6, 'alive')")
    other = Engine(spark, people.store.files.root)
    assert other.recovered["undone"] == other.vacuum() == []
    writer.commit()
    assert sorted(r["id"] for r in Engine(spark, people.store.files.root).execute("SELECT id FROM people").collect())[-1] == 6


def test_a_commit_whose_files_are_gone_fails_as_a_whole(people):
    writer = people.session()
    writer.begin()
    writer.execute("INSERT INTO people (id, name) VALUES (6, 'x')")
    people.store.files.delete(next(a["path"] for a in writer.txn.actions if "path" in a))
    before = people.store.log.last()
    with pytest.raises(EngineError) as e:
        writer.commit()
    assert e.value.status.name == "IO_ERROR"
    assert people.store.log.last() == before
    assert people.active_transactions() == []


def test_errors_of_values_are_statuses_and_leave_nothing_behind(people):
    files = lambda: sorted(f"{t}/{n}" for t in people.store.files.names("tables") for n in people.store.files.names(f"tables/{t}"))
    before = files()
    for text in ("INSERT INTO people (id, name) VALUES (3000000000, 'x')", "DELETE FROM people WHERE 1 / (id - id) > 0", "INSERT INTO people (id) VALUES ('x')", "DELETE FROM nowhere"):
        assert people.execute_update(text).name in ("INVALID_ARGUMENT", "TYPE_MISMATCH", "NOT_FOUND")
        assert people.active_transactions() == []
    assert files() == before
    assert people.execute("SELECT id FROM people").count() == 3


def test_counts_follow_writes_and_registrations(spark, people):
    assert people.cardinality("people") == 3
    people.execute("DELETE FROM people WHERE id = 1")
    assert people.cardinality("people") == 2
    people.register("seen", spark.range(4))
    assert people.cardinality("seen") == 4
    people.register("seen", spark.range(5))
    assert people.cardinality("seen") == 5


def test_indexes_are_made_again_listed_and_dropped(engine, spark, sf):
    engine.register("orders", f"{sf}/orders.parquet")
    rows = engine.read("orders").count()
    for column in ("o_orderkey", "o_orderkey", "o_custkey"):
        engine.create_index("orders", column)
        assert engine.read("orders").count() == rows
    assert engine.open_index("orders").column == "o_custkey"
    assert [tuple(r) for r in engine.list_indexes().collect()] == [("orders", "o_custkey")]
    engine.drop_index("orders")
    assert engine.read("orders").count() == rows
    assert engine.list_indexes().count() == 0
    with pytest.raises(EngineError):
        engine.open_index("orders")


def test_redo_needs_no_sort_and_a_checkpoint_says_who_is_active(spark):
    from tessera.operators import logreplay

    rows = [(1, 1, "UPDATE", 7, 10, None), (2, 4, "INSERT", 9, 1, None), (3, 5, "COMMIT", None, None, None), (4, None, "CHECKPOINT", None, None, [4, 6]), (5, 2, "INSERT", 8, 5, None), (6, 3, "DELETE", 7, None, None), (7, 3, "COMMIT", None, None, None)]
    log = spark.createDataFrame(rows, "lsn long, txn long, kind string, rid long, val long, active array<long>")
    assert {(r["txn"], r["outcome"]) for r in logreplay.analysis(log).collect()} == {(2, "ACTIVE"), (3, "COMMITTED"), (4, "ACTIVE"), (5, "COMMITTED"), (6, "ACTIVE")}
    assert {(r["txn"], r["outcome"]) for r in logreplay.analysis(log.drop("active")).collect()} == {(1, "ACTIVE"), (2, "ACTIVE"), (3, "COMMITTED"), (4, "ACTIVE"), (5, "COMMITTED")}
    assert {(r["txn"], r["outcome"]) for r in logreplay.analysis(log.filter("lsn < 4")).collect()} == {(1, "ACTIVE"), (4, "ACTIVE"), (5, "COMMITTED")}
    assert logreplay.redo(log).count() == 0
    assert {tuple(r) for r in logreplay.undo(log).collect()} == {(2, 1), (4, 1)}
    assert "SortAggregate" not in logreplay.redo(log)._jdf.queryExecution().executedPlan().toString()


def test_the_flagship_pushes_its_filters(spark, sf):
    from tessera.plans import catalogue

    plan = catalogue.queries()["flagship"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,30.0)" in plan
    assert "GreaterThan(o_totalprice,1000.0)" in plan
