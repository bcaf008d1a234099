import struct

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import pg
from tarnlake.operators import relational
from tarnlake.session import Session
from tarnlake.sources import copy_format as cf
from tarnlake.sources import dump
from tarnlake.sources.storage import SqlError
from tarnlake.streaming import windows


def test_copy_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\ta\\tb\\nc\n2\t\\N\n3\t\\x41\\102\\\\\\q\n4\t\n5\tx\\\ty\n\\.\n")
    got = [tuple(r) for r in cf.read_text(spark, str(tmp_path / "a.txt"), ["i", "t"]).orderBy("i").collect()]
    assert got == [("1", "a\tb\nc"), ("2", None), ("3", "AB\\q"), ("4", ""), ("5", "x\ty")]
    (tmp_path / "b.txt").write_text("1\n")
    with pytest.raises(Exception, match="22P04"):
        cf.read_text(spark, str(tmp_path / "b.txt"), ["i", "t"]).collect()


def test_copy_csv_and_round_trips(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"say ""hi"""\n2,"two\nlines"\n3,\n4,""\n')
    df = cf.read_csv(spark, str(tmp_path / "a.csv"), ["id", "t"], header=True)
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert got == [("1", 'say "hi"'), ("2", "two\nlines"), ("3", None), ("4", "")]
    cf.write_csv(df.coalesce(1), str(tmp_path / "out.csv"))
    assert sorted(tuple(r) for r in cf.read_csv(spark, str(tmp_path / "out.csv"), ["id", "t"]).collect() if r.t) == [r for r in got if r[1]]
    cf.write_text(df, str(tmp_path / "out.txt"))
    assert sorted((tuple(r) for r in cf.read_text(spark, str(tmp_path / "out.txt"), ["id", "t"]).collect()), key=lambda r: r[0]) == got


def test_copy_binary(spark, tmp_path):
    f = lambda b: struct.pack(">i", len(b)) + b
    row = struct.pack(">h", 4) + f(struct.pack(">i", -7)) + f("é".encode()) + f(b"\1") + struct.pack(">i", -1)
    data = cf.SIGNATURE + struct.pack(">ii", 0, 0) + row + row + struct.pack(">h", -1)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(data)
    kinds = {"i": "int", "t": "string", "b": "boolean", "d": "double"}
    assert [tuple(r) for r in cf.read_binary(spark, str(tmp_path / "d"), kinds).collect()] == [(-7, "é", True, None)] * 2
    for bad in (data[:-9], b"nope" + data):
        with pytest.raises(SqlError):
            cf.decode_binary(bad, list(kinds.values()))


def test_copy_header():
    c = cf.parse_copy("COPY s.t (a, b) FROM STDIN WITH (FORMAT csv, HEADER true, NULL 'x', DELIMITER ';')")
    assert (c.table, c.columns, c.format, c.delimiter, c.null, c.header, c.to) == ("s.t", ["a", "b"], "csv", ";", "x", True, False)
    with pytest.raises(SqlError):
        cf.parse_copy("COPY t (a;b) FROM STDIN")


DUMP = """-- a dump
SET client_encoding = 'UTF8';
CREATE TABLE public.p (id integer NOT NULL, name text, note text DEFAULT 'a;b');
COPY public.p (id, name) FROM stdin;
1\tone; two
2\t\\N
\\.
ALTER TABLE ONLY public.p ADD CONSTRAINT p_pkey PRIMARY KEY (id);
CREATE INDEX p_name ON public.p USING btree (name);
INSERT INTO public.p VALUES (3, 'it''s', NULL);
SELECT pg_catalog.setval('s', 1);
"""


def test_dump(spark, tmp_path):
    db = Session(spark, str(tmp_path / "s"))
    report = dump.load(db, DUMP)
    assert (report.tables, report.rows, len(report.skipped)) == (1, 3, 2)
    assert sorted(map(tuple, db.sql("SELECT * FROM p").collect())) == [(1, "one; two", "a;b"), (2, None, "a;b"), (3, "it's", None)]
    with pytest.raises(SqlError):
        db.sql("INSERT INTO p VALUES (3, 'x', 'y')")


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    d = lambda x: F.to_date(F.lit(x))
    assert one(pg.age(d("2024-03-01"), d("2023-01-31"))) == "1 year 1 mon 1 day"
    assert one(pg.age(d("2024-01-01"), d("2024-01-01"))) == "00:00:00"
    assert one(pg.age(d("2024-01-10"), d("2024-03-12"))) == "-2 mons -2 days"
    assert one(pg.concat(F.lit("a"), F.lit(None), F.lit(1))) == "a1"
    assert one(pg.trim(F.lit("\t a\n"))) == "a"
    assert one(pg.substr(F.lit("abcdef"), F.lit(-3), F.lit(2))) == "ab"
    assert one(pg.to_boolean(F.lit("on"))) is True and one(pg.to_boolean(F.lit("maybe"))) is None
    assert one(pg.to_integer(F.lit(2.5))) == 2 and one(pg.to_integer(F.lit(3.5))) == 4
    assert one(pg.array_contains_all(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) is True
    with pytest.raises(ValueError):
        pg.date_trunc("eon", F.lit(None))


def test_ordinality_and_streaming_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, v array<string>")
    got = relational.with_ordinality(df, F.col("v"), outer=True).select("id", "value", "ordinality")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", 1), (1, "b", 2), (2, None, None)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(400).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    made = windows.tumbling(stream, "ts", "1 hour", ["event_type"], "10 minutes").count()
    made.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert spark.sql("select sum(count) from w").first()[0] == 400
    assert windows.sessions(events, "ts", "30 minutes", ["user_id"]).count().count() > 0
    assert windows.sliding(events, "ts", "2 hours", "1 hour", []).count().count() > 0
