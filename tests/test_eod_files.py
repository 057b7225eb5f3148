from __future__ import annotations

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import eod_files

HEAD = ",".join(eod_files.BAR_COLUMNS)
GOOD = "ABC,EQ,1,2,0.5,1.5,1.5,1,100,150.5,02-JAN-2006"


def run(spark, lines):
    df = spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, raw string")
    found = {(r.line_id, r.reason) for r in eod_files.rejects(df).collect()}
    loaded = {r.line_id for r in eod_files.strict_load(df).collect()}
    return found, loaded


def bar(*raws, head=HEAD, name="drop/cm02JAN2006bhav.csv"):
    return [(0, name, 1, head)] + [(i, name, i + 1, r) for i, r in enumerate(raws, 1)]


def test_reasons_of_bar_lines(spark):
    lines = bar(
        GOOD, "", GOOD + ",", GOOD.replace("ABC", '"A,B ""C"""'), GOOD.replace("ABC", 'A"BC'), GOOD.replace(",100,", ", 100 ,"), GOOD.replace(",100,", ",1e2,"),
        GOOD.replace(",100,", ",9223372036854775808,"), GOOD.replace("02-JAN-2006", "31-FEB-2006\r"), GOOD.replace("02-JAN-2006", "2-JAN-2006\r"), GOOD.replace("02-JAN-2006", "02-Jan-2006").replace(",100,", ",-1,"),
        None, GOOD.replace("02-JAN-2006", '"02-JAN-2006"\r'), GOOD.replace("02-JAN-2006", "29-FEB-2004"), GOOD.replace("02-JAN-2006", "29-FEB-2005"), '"' + GOOD,
    )
    found, loaded = run(spark, lines)
    assert found == {
        (2, "column_count"), (3, "column_count"), (5, "quoting"), (7, "tottrdqty"), (8, "tottrdqty"), (9, "timestamp"), (11, "timestamp"), (11, "tottrdqty"), (12, "column_count"), (15, "timestamp"), (16, "quoting"),
    }
    assert loaded == {1, 4, 6, 10, 13, 14}


def test_header_decides_width_and_order(spark):
    head = "﻿ TIMESTAMP, SYMBOL,SERIES,TOTTRDQTY,EXTRA\r"
    found, loaded = run(spark, bar("02-JAN-2006,A,EQ,5,x", "x,A,EQ,5,x", "02-JAN-2006,A,EQ,5", head=head))
    assert found == {(2, "timestamp"), (3, "column_count")} and loaded == {1}


def test_delivery_lines(spark):
    name = "d/MTO_02012006.DAT"
    raws = ["Delivery", "10,MTO,x", "20,1,A,EQ,10,5,50.00", "20,1,A,EQ,10,5,-", "20,1,A,BE,10,5,-", "20,1,A,EQ,10,5,100.01", "20,1,A,EQ,10,5,100", "20,1,A,EQ,10,5,", "20,1,A,EQ,10,5", "2006", None, "20,1,A,EQ,x,y,7"]
    found, loaded = run(spark, [(i, name, i + 1, r) for i, r in enumerate(raws)])
    assert found == {(3, "deliv_per"), (5, "deliv_per"), (7, "deliv_per"), (8, "column_count"), (9, "column_count")}
    assert loaded == {2, 4, 6, 11}


def test_empty_nulls_and_clashing_columns(spark):
    schema = "line_id bigint, file_name string, line_no int, raw string, bar string, fields string, header string"
    assert eod_files.rejects(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, 2, GOOD, "x", "y", "z"), (2, "a/cm1bhav.csv", None, GOOD, "x", "y", "z"), (None, "a/cm1bhav.csv", 2, "bad", "x", "y", "z"), (3, "a/cm1bhav.csv", 3, GOOD, "x", "y", "z"), (3, "a/cm1bhav.csv", 3, GOOD, "x", "y", "z")]
    df = spark.createDataFrame(rows, schema)
    assert [r.reason for r in eod_files.rejects(df).collect()] == ["column_count"]
    assert eod_files.strict_load(df).count() == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='ab,"" ', max_size=12), min_size=1, max_size=40))
def test_quoting_against_a_state_machine(spark, raws):
    def reference(line):
        """Fields of a line, None if a quote is used in any other way than allowed."""
        fields, i = [], 0
        while True:
            if line[i : i + 1] == '"':
                i += 1
                out = ""
                while True:
                    end = line.find('"', i)
                    if end < 0:
                        return None
                    out += line[i:end]
                    i = end + 1
                    if line[i : i + 1] != '"':
                        break
                    out, i = out + '"', i + 1
                if line[i : i + 1] not in ("", ","):
                    return None
            else:
                end = line.find(",", i)
                end = len(line) if end < 0 else end
                out = line[i:end]
                if '"' in out:
                    return None
                i = end
            fields.append(out.strip(" \t\r\n\xa0﻿"))
            if i >= len(line):
                return fields
            i += 1

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, line string")
    got = df.select("i", eod_files.quoting_ok(F.col("line")).alias("ok"), eod_files.fields_of(F.col("line")).alias("f")).collect()
    for r in got:
        want = reference(raws[r.i])
        assert r.ok == (want is not None), raws[r.i]
        if want is not None:
            assert r.f == want, raws[r.i]


def test_agrees_with_the_csv_module():
    assert next(csv.reader(io.StringIO('"A,B ""C""",EQ'))) == ['A,B "C"', "EQ"]


@pytest.mark.parametrize("text,ok", [("1-JAN-2006", True), ("01-JAN-0000", False), ("00-JAN-2006", False), ("1-JANUARY-2006", False), ("1-JAN-06", False), ("31-APR-2006", False)])
def test_dates(spark, text, ok):
    from pyspark.sql import functions as F

    assert (spark.range(1).select(eod_files.real_date(F.lit(text))).first()[0] is not None) == ok
