import pytest

from tarnlake.session import Result, Session
from tarnlake.sources.storage import SqlError


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, str(tmp_path / "store"))


def rows(df):
    df = df.rows if isinstance(df, Result) else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fails(db, text, state):
    with pytest.raises(SqlError) as e:
        db.sql(text)
    assert e.value.sqlstate == state


def test_insert_defaults_update_delete_returning(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, a INT DEFAULT 10, b TEXT DEFAULT 'x' NOT NULL)")
    assert db.sql("INSERT INTO t (id) VALUES (1), (2)").tag == "INSERT 0 2"
    db.sql("INSERT INTO t VALUES (3, DEFAULT, 'y'), (4, 1 + 1, upper('z'))")
    assert rows(db.sql("SELECT * FROM t")) == [(1, 10, "x"), (2, 10, "x"), (3, 10, "y"), (4, 2, "Z")]
    assert rows(db.sql("UPDATE t SET a = t.a + 1, b = DEFAULT WHERE id >= 3 RETURNING id, a * 2 AS d")) == [(3, 22), (4, 6)]
    assert rows(db.sql("DELETE FROM t WHERE id IN (SELECT id FROM t WHERE a = 10) RETURNING id")) == [(1,), (2,)]
    assert rows(db.sql("SELECT * FROM t")) == [(3, 11, "x"), (4, 3, "x")]
    db.sql("INSERT INTO t SELECT id + 10, a, b FROM t")
    assert db.sql("SELECT * FROM t").count() == 4
    db.sql("INSERT INTO t SELECT 21")  # without a list the first columns are filled
    assert rows(db.sql("SELECT * FROM t WHERE id = 21")) == [(21, 10, "x")]
    fails(db, "INSERT INTO t SELECT 22, 1, 'a', 2", "42601")
    fails(db, "INSERT INTO t (id, a) SELECT 22", "42601")


def test_constraints(db):
    db.sql("CREATE TABLE p (id INT PRIMARY KEY, email TEXT UNIQUE, age INT NOT NULL CHECK (age >= 0))")
    db.sql("CREATE TABLE c (id INT, pid INT REFERENCES p(id), k INT, UNIQUE (pid, k))")
    db.sql("INSERT INTO p VALUES (1, 'a', 5), (2, NULL, 6), (3, NULL, 7)")
    fails(db, "INSERT INTO p VALUES (1, 'b', 1)", "23505")
    fails(db, "INSERT INTO p VALUES (4, 'q', 1), (4, 'r', 1)", "23505")
    fails(db, "INSERT INTO p VALUES (5, 'z', NULL)", "23502")
    fails(db, "INSERT INTO p VALUES (5, 'z', -1)", "23514")
    fails(db, "UPDATE p SET email = 'a' WHERE id = 2", "23505")
    db.sql("INSERT INTO c VALUES (1, 1, 1), (2, 1, 2), (3, NULL, 1)")
    fails(db, "INSERT INTO c VALUES (4, 9, 1)", "23503")
    fails(db, "INSERT INTO c VALUES (4, 1, 2)", "23505")
    assert db.sql("SELECT * FROM p").count() == 3 and db.sql("SELECT * FROM c").count() == 3


def test_upsert(db):
    db.sql("CREATE TABLE k (id INT PRIMARY KEY, name TEXT, n INT DEFAULT 0)")
    db.sql("INSERT INTO k VALUES (1, 'a', 1)")
    assert db.sql("INSERT INTO k VALUES (1, 'b', 2), (2, 'c', 3) ON CONFLICT DO NOTHING").tag == "INSERT 0 1"
    db.sql("INSERT INTO k VALUES (1, 'z', 5), (3, 'd', 4) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, n = k.n + EXCLUDED.n")
    assert rows(db.sql("SELECT * FROM k")) == [(1, "z", 6), (2, "c", 3), (3, "d", 4)]
    fails(db, "INSERT INTO k VALUES (1, 'p', 1), (1, 'q', 1) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name", "21000")


def test_transactions_savepoints_conflicts(spark, db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    db.sql("CREATE TABLE u (id INT PRIMARY KEY)")
    other = Session(spark, db.store.root)
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (1)")
    db.sql("SAVEPOINT s")
    db.sql("INSERT INTO t VALUES (2)")
    db.sql("ROLLBACK TO SAVEPOINT s")
    assert rows(db.sql("SELECT * FROM t")) == [(1,)] and rows(other.sql("SELECT * FROM t")) == []
    other.sql("INSERT INTO u VALUES (7)")  # another table: no conflict
    db.sql("COMMIT")
    assert rows(other.sql("SELECT * FROM t")) == [(1,)] and rows(db.sql("SELECT * FROM u")) == [(7,)]
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (3)")
    other.sql("INSERT INTO t VALUES (4)")
    fails(db, "COMMIT", "40001")
    assert rows(db.sql("SELECT * FROM t")) == [(1,), (4,)]
    db.sql("BEGIN")
    db.sql("DELETE FROM t")
    assert db.sql("ROLLBACK").tag == "ROLLBACK"
    assert db.sql("SELECT * FROM t").count() == 2


def test_ddl_views_indexes_alter_roles_settings(spark, db):
    db.sql("CREATE SCHEMA s")
    db.sql("CREATE TABLE s.t (id INT PRIMARY KEY, v NUMERIC(10, 2), tags TEXT[])")
    db.sql("INSERT INTO s.t VALUES (1, 1.25, ARRAY['a', 'b']), (2, 2.5, ARRAY['c'])")
    db.sql("CREATE VIEW big AS SELECT id, v FROM s.t WHERE v > 2")
    assert [r[0] for r in rows(db.sql("SELECT id FROM big"))] == [2]
    db.sql("ALTER TABLE s.t ADD COLUMN n INT DEFAULT 7")
    db.sql("ALTER TABLE s.t RENAME COLUMN n TO m")
    db.sql("ALTER TABLE s.t ALTER COLUMN m TYPE TEXT")
    assert rows(db.sql("SELECT id, m FROM s.t WHERE tags @> ARRAY['b']")) == [(1, "7")]
    db.sql("CREATE UNIQUE INDEX ix ON s.t (v)")
    fails(db, "INSERT INTO s.t VALUES (3, 2.5, NULL, 'x')", "23505")
    names = [r[0] for r in rows(db.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 't'"))]
    assert names == ["id", "m", "tags", "v"]
    assert rows(db.sql("SELECT indexname FROM pg_indexes")) == [("ix",)]
    db.sql("CREATE ROLE bob LOGIN")
    db.sql("GRANT SELECT ON s.t TO bob")
    bob = Session(spark, db.store.root, role="bob")
    assert bob.sql("SELECT id FROM s.t").count() == 2
    fails(bob, "DELETE FROM s.t", "42501")
    db.sql("SET statement_timeout = 5")
    assert rows(db.sql("SHOW statement_timeout")) == [("5",)]
    db.sql("DROP VIEW big")
    db.sql("DROP TABLE IF EXISTS nothing")
    fails(db, "DROP TABLE nothing", "42P01")
    fails(db, "MERGE INTO x", "42601")


def test_dialect(db):
    one = lambda q, *p: rows(db.sql(q, list(p) or None))
    assert one("SELECT concat('a', NULL, 'b') AS c, '2.5'::int AS i, 'x' || $1 AS p", "y") == [("ab", 2, "xy")]
    assert one("SELECT i FROM generate_series(1, 7, 3) AS g(i)") == [(1,), (4,), (7,)]
    assert one("SELECT i FROM generate_series(5, 1) AS g(i)") == []
    assert one("SELECT a, b FROM unnest(ARRAY[1, 2], ARRAY['x']) AS u(a, b)") == [(1, "x"), (2, None)]
    assert one("SELECT v, n FROM unnest(ARRAY['p', 'q']) WITH ORDINALITY AS u(v, n)") == [("p", 1), ("q", 2)]
    assert one("SELECT w FROM regexp_split_to_table('a,b', ',') AS r(w)") == [("a",), ("b",)]
    assert one("""SELECT '{"a": {"b": [1, 2]}}'::jsonb #>> '{a,b,1}' AS v, '{"a": 1}' ->> 'a' AS w""") == [("2", "1")]
    assert one("""SELECT '{"a": 1, "b": [1, 2]}' @> '{"b": [2]}' AS y, '{"a": 1}' @> '{"a": 2}' AS n""") == [(True, False)]
    assert one("SELECT x.n FROM (SELECT 1 AS n) x WHERE 'abc' ~ '^a' AND 'ABC' ~* 'b' AND 1 = ANY(ARRAY[1, 2])") == [(1,)]
    assert one("SELECT CAST(DATE '2024-01-31' + INTERVAL '1 month 2 days' AS STRING) AS d") == [("2024-03-02",)]
    db.sql("CREATE TABLE e (src INT, dst INT)")
    db.sql("INSERT INTO e VALUES (1, 2), (2, 3), (3, 4), (4, 2)")
    assert one("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.n) SELECT n FROM r") == [(1,), (2,), (3,), (4,)]
    assert one("SELECT DISTINCT ON (src % 2) src, dst FROM e ORDER BY src % 2, dst DESC") == [(2, 3), (3, 4)]
    assert one("SELECT src FROM e ORDER BY src FETCH FIRST 2 ROWS ONLY") == [(1,), (2,)]


def test_tables_are_read_as_they_are_now(db):
    db.sql("CREATE TABLE u (x INT)")
    db.sql("CREATE TABLE t (a INT)")
    db.sql("INSERT INTO u VALUES (1)")
    db.sql("INSERT INTO t VALUES (0)")
    assert rows(db.sql("SELECT * FROM u")) == [(1,)]
    db.sql("INSERT INTO u VALUES (100)")
    db.sql("UPDATE t SET a = (SELECT max(x) FROM u)")
    db.sql("INSERT INTO t VALUES ((SELECT max(x) + 1 FROM u))")
    assert rows(db.sql("SELECT * FROM t")) == [(100,), (101,)]
    db.sql("DROP TABLE u")
    with pytest.raises(Exception):
        db.sql("SELECT * FROM u")


def test_rights_are_denied_by_default_and_audited(spark, db):
    for text in ("CREATE TABLE t (a INT)", "CREATE TABLE u (a INT)", "CREATE ROLE bob", "CREATE ROLE team", "GRANT UPDATE ON t TO bob"):
        db.sql(text)
    bob = Session(spark, db.store.root, role="bob")
    for text in ("SELECT * FROM t", "GRANT ALL ON t TO bob", "REVOKE UPDATE ON t FROM bob", "DROP TABLE t", "ALTER TABLE t ADD COLUMN b INT", "CREATE INDEX i ON t (a)", "CREATE VIEW v AS SELECT 1 AS a", "CREATE SCHEMA s", "TRUNCATE t", "COPY t TO '/tmp/x'", "UPDATE t SET a = (SELECT max(a) FROM u)", "GRANT team TO bob", "DROP ROLE team"):
        fails(bob, text, "42501")
    bob.sql("UPDATE t SET a = 1")
    db.sql("GRANT SELECT ON t TO team")
    db.sql("GRANT team TO bob")
    assert rows(bob.sql("SELECT * FROM t")) == []
    assert [(d.action, d.resource, d.allowed, d.reason) for d in bob.audit][-1] == ("SELECT", "t", True, "granted")
    assert ("DROP", "t", False) in [(d.action, d.resource, d.allowed) for d in bob.audit]


def test_grants_of_two_committers_both_stay(spark, db):
    for text in ("CREATE TABLE t (a INT)", "CREATE ROLE a", "CREATE ROLE b"):
        db.sql(text)
    other = Session(spark, db.store.root)
    db.sql("BEGIN")
    db.sql("GRANT SELECT ON t TO a")
    other.sql("GRANT SELECT ON t TO b")
    other.sql("CREATE SCHEMA s")
    db.sql("COMMIT")
    assert sorted(g[2] for g in db.state["grants"]) == ["a", "b"] and db.state["schemas"] == ["public", "s"]


def test_a_version_is_whole_or_absent(spark, db):
    db.sql("CREATE TABLE t (a INT)")
    assert not db.store._put(f"{db.store.root}/versions/1.json", "half")  # the name is taken
    assert db.store.read(1)["tables"].keys() == {"t"} and db.store.versions() == [1]
    for _ in range(3):
        db.sql("INSERT INTO t VALUES (1)")
    assert len(db.state["tables"]["t"]["data"]) == 3
    db.sql("VACUUM t")
    assert len(db.state["tables"]["t"]["data"]) == 1 and db.sql("SELECT * FROM t").count() == 3
    assert db.store.vacuum(keep=1, age=0.0) == 3 and db.store.versions() == [5] and db.sql("SELECT * FROM t").count() == 3


def test_portals_stream_and_cursors(db):
    portal = db.portal("SELECT i FROM generate_series(1, 10) AS g(i) ORDER BY i")
    assert [r[0] for r in portal.fetch(3)] == [1, 2, 3] and len(portal.fetch(100)) == 7 and portal.fetch(1) == []
    seen = []
    assert db.stream("SELECT i FROM generate_series(1, 4) AS g(i)", seen.append) == 4 and len(seen) == 4
    fails(db, "DECLARE c CURSOR FOR SELECT 1", "25P01")
    fails(db, "FETCH 1 FROM c", "34000")


def test_copy_in_and_out(db):
    db.sql("CREATE TABLE t (id INT, name TEXT, good BOOLEAN)")
    assert db.copy_in("COPY t (id, name) FROM STDIN", "1\ta\\tb\n2\t\\N\n").tag == "COPY 2"
    assert db.copy_in("COPY t FROM STDIN (FORMAT csv, HEADER)", 'id,name,good\n3,"x,""y""",t\n4,,\n').tag == "COPY 2"
    assert rows(db.sql("SELECT id, name, good FROM t")) == [(1, "a\tb", None), (2, None, None), (3, 'x,"y"', True), (4, None, None)]
    assert sorted(db.copy_out("COPY (SELECT id, name FROM t WHERE id < 3) TO STDOUT")) == ["1\ta\\tb", "2\t\\N"]
    assert sorted(db.copy_out("COPY t TO STDOUT (FORMAT csv, HEADER)"))[-1] == "id,name,good"
    fails(db, "COPY t (nothing) FROM '/tmp/none'", "42703")


def test_catalog_relations_resolve(db):
    from tarnlake.plans import system

    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v NUMERIC(10, 2) DEFAULT 1 CHECK (v > 0))")
    db.sql("CREATE TABLE c (tid INT REFERENCES t(id))")
    for name in system.RELATIONS:
        schema = "pg_catalog" if name.startswith("pg_") else "information_schema"
        assert db.sql(f"SELECT * FROM {schema}.{name}").columns
    assert rows(db.sql("SELECT conname, conkey FROM pg_constraint WHERE contype = 'f'")) == [("c_tid_fkey", [1])]
    assert rows(db.sql("SELECT ssl FROM pg_stat_ssl")) == [(False,)]
    assert rows(db.sql("SELECT format_type(1043, 0) AS f, pg_get_userbyid(10) AS u")) == [("character varying", "postgres")]


@pytest.mark.parametrize(
    "query",
    [
        "SELECT c.id, o.v FROM c JOIN LATERAL (SELECT v FROM o WHERE o.id = c.id ORDER BY at DESC, v LIMIT 1) o ON TRUE",
        "SELECT id, (SELECT v FROM o WHERE o.id = c.id ORDER BY o.at + 0 DESC, 1 FETCH FIRST ROW ONLY) AS v FROM c",
        "SELECT c.id, o.v FROM c JOIN LATERAL (WITH w AS (SELECT * FROM o) SELECT v FROM w WHERE w.id = c.id ORDER BY at DESC NULLS LAST, v LIMIT 1) o ON TRUE",
    ],
)
def test_limit_of_a_correlated_subquery_keeps_its_order(db, query):
    db.sql("CREATE TABLE c AS SELECT id FROM range(5)")
    db.sql("CREATE TABLE o AS SELECT id % 5 AS id, (id * 7) % 40 AS at, 1000 - id AS v FROM range(40)")
    found = db.sql(query)
    best = {}
    for i in range(40):
        best[i % 5] = max(best.get(i % 5, (-1, 0)), ((i * 7) % 40, 1000 - i))
    assert rows(found) == [(k, best[k][1]) for k in range(5)]
    # without its keys the rows are numbered in whatever order a shuffle brings them
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(id" in plan and all("DESC" in line for line in plan.splitlines() if "row_number() windowspecdefinition" in line)


def test_rows_that_a_change_meets_are_told_by_numbers(db, monkeypatch):
    for text in ("CREATE TABLE t (id BIGINT, v TEXT)", "CREATE TABLE u (id BIGINT)", "INSERT INTO u SELECT id % 10 FROM range(40)"):
        db.sql(text)
    for start in (0, 100, 200):  # several folders and files, with the same row numbers
        db.sql(f"INSERT INTO t SELECT id + {start}, 'v' FROM range(20)")
    written, write = [], db.store.write_data
    monkeypatch.setattr(db.store, "write_data", lambda df: (written.append(df), write(df))[1])
    assert db.sql("DELETE FROM t USING u WHERE t.id = u.id + 100").tag == "DELETE 10"
    assert written[0].dtypes == [("tl_at", "bigint")]  # no paths, and no columns that nobody asked for
    assert rows(db.sql("UPDATE t SET v = 'w' FROM u WHERE t.id = u.id RETURNING t.id")) == [(i,) for i in range(10)]
    assert rows(db.sql("DELETE FROM t AS x USING u WHERE x.id = u.id + 200 RETURNING id, v")) == [(i, "v") for i in range(200, 210)]
    assert db.sql("DELETE FROM t WHERE id IN (SELECT id + 210 FROM u)").tag == "DELETE 10"
    joins = [line for df in written for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "Anti" in line]
    assert joins and not any("tl_file" in line for line in joins)
    assert set(rows(db.sql("SELECT * FROM t"))) == {(i, "w" if i < 10 else "v") for i in [*range(20), *range(110, 120)]} and db.sql("SELECT * FROM t").count() == 30
