"""Exchange end-of-day files: strict load, and rejects with their reasons.

The lines of bar files (``cm...bhav.csv``: header in line 1) and delivery files
(``MTO_....DAT``: data lines start with 20) are loaded strictly: only a line whose
shape and checked fields conform is loaded, under its offset (line id, file,
line number).  The rejects are the raw offsets less the loaded ones (an anti-join), and
only those are diagnosed, so the reasons never decide what is loaded.

Everything is a Catalyst expression, no Python per line.  Header widths come by a
join on the file name whose small side is one row a file; AQE broadcasts it
while it is small and splits a file that holds much of the lines when not.

Defined cases: null raw text of a bar file counts as an empty line (one field, so
``column_count``); lines without file name or line number are no data lines; a bar
file without a header line is held against the eleven standard columns; empty
tables give no rows; repeated lines count each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Columns of a bar file; fixed values.
BAR_COLUMNS = ("SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE", "TOTTRDQTY", "TOTTRDVAL", "TIMESTAMP")
#: Months as the files spell them; fixed values.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DELIVERY_FIELDS = 7
_BLANKS = " \t\r\n\xa0\ufeff"
_COMMA, _QUOTE = "\ue000", "\ue001"  # stand for a comma and a quote inside a quoted field


def _line(raw: Column) -> Column:
    """The line without byte order mark and line end."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), "^\ufeff+|[\r\n]+$", "")


def quoting_ok(line: Column) -> Column:
    """True if every quote encloses a whole field or is doubled inside one."""

    def good(parts: Column) -> Column:
        n = F.size(parts)

        def outside(s: Column, i: Column) -> Column:
            left_ok = (i == 0) | s.startswith(",")
            right_ok = (i == n - 1) | s.endswith(",")
            # an empty part is the seam of a doubled quote, or the line's edge
            return (i % 2 == 1) | (s == "") | (left_ok & right_ok)

        return (n % 2 == 1) & F.forall(F.transform(parts, outside), lambda x: x)

    return F.when(F.instr(line, '"') == 0, True).otherwise(let(F.split(line, '"', -1), good))


def _trimmed(field: Column) -> Column:
    return F.btrim(field, F.lit(_BLANKS))


def fields_of(line: Column) -> Column:
    """Fields of a line whose quoting is right: quotes and outer blanks removed."""
    return F.transform(_cut(line), _trimmed)


def _cut(line: Column) -> Column:
    """Fields without their quotes; those that are read are trimmed then."""

    def quoted(parts: Column) -> Column:
        def masked(s: Column, i: Column) -> Column:
            seam = (s == "") & (i > 0) & (i < F.size(parts) - 1)
            return F.when(i % 2 == 1, F.translate(s, ",", _COMMA)).when(seam, F.lit(_QUOTE)).otherwise(s)

        plain = F.array_join(F.transform(parts, masked), "")
        return F.transform(F.split(plain, ",", -1), lambda f: F.translate(f, _COMMA + _QUOTE, ',"'))

    return F.when(F.instr(line, '"') == 0, F.split(line, ",", -1)).otherwise(let(F.split(line, '"', -1), quoted))


def shape_of(raw: Column) -> Column:
    """struct(good_quotes, fields) of a raw line."""
    return let(_line(raw), lambda line: F.struct(quoting_ok(line).alias("good_quotes"), _cut(line).alias("fields")))


def valid_quantity(field: Column) -> Column:
    return F.coalesce(field.rlike(r"^[0-9]+\z") & field.try_cast("bigint").isNotNull(), F.lit(False))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once.

    A filter on a computed column has the expression put in wherever the column stands, so
    costly steps (regular expressions, splits) are bound as a lambda's variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def real_date(field: Column) -> Column:
    """DATE of a d-MMM-yyyy text (month in capitals), null if it is none."""
    months = F.array(*[F.lit(m) for m in MONTHS])

    def spelled(piece: Column) -> Column:
        month = F.array_position(months, F.get(piece, F.lit(1))).cast("string")
        text = F.concat_ws("-", F.get(piece, F.lit(2)), F.lpad(month, 2, "0"), F.lpad(F.get(piece, F.lit(0)), 2, "0"))
        return F.when(F.get(piece, F.lit(2)) != "0000", text.try_cast("date"))

    return F.when(field.rlike(rf"^[0-9]{{1,2}}-({'|'.join(MONTHS)})-[0-9]{{4}}\z"), let(F.split(field, "-"), spelled))


def valid_percentage(field: Column, series: Column) -> Column:
    number = field.rlike(r"^[0-9]+(\.[0-9]+)?\z") & (field.try_cast("double") <= 100)
    return F.coalesce(F.when(field == "-", ~series.eqNullSafe("EQ")).otherwise(number), F.lit(False))


#: Fields of a bar line that are read, by their header.
_READ = ("SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE", "TOTTRDQTY", "TOTTRDVAL", "TIMESTAMP")
#: Prices and value of a bar line, by the name they are loaded under.
_NUMBERS = {"open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "last": "LAST", "prev_close": "PREVCLOSE", "value": "TOTTRDVAL"}


def _typed(lines: DataFrame) -> DataFrame:
    name = F.element_at(F.split("file_name", "/"), -1)
    kinds = (name.rlike("^cm.*bhav\\.csv$").alias("bar"), name.rlike("^MTO_.*\\.DAT$").alias("delivery"))
    return lines.select("line_id", "file_name", "line_no", "raw", *kinds).where("bar or delivery")


def data_lines(lines: DataFrame) -> DataFrame:
    """The lines that hold data, with `bar` (bar or delivery file)."""
    return _typed(lines).where("(bar and line_no > 1) or (delivery and startswith(raw, '20'))").drop("delivery")


def with_layout(data: DataFrame, lines: DataFrame) -> DataFrame:
    """data with the width of its file's header and where it has each field.

    Only the raw text and some small numbers travel; fields are cut out where they are needed.
    """
    columns = F.transform(fields_of(_line(F.col("header"))), F.upper)
    headers = (
        _typed(lines)
        .where("bar and line_no = 1")
        .groupBy("file_name")
        .agg(F.min("raw").alias("header"))
        .select(F.col("file_name").alias("header_of"), columns.alias("columns"))
        .select("header_of", F.size("columns").alias("width"), *[F.array_position("columns", F.lit(c)).cast("int").alias(f"at_{c}") for c in _READ])
    )
    joined = data.join(headers, data.file_name == headers.header_of, "left").drop("header_of")
    standard = {f"at_{c}": F.coalesce(f"at_{c}", F.lit(BAR_COLUMNS.index(c) + 1)) for c in _READ}
    return joined.withColumns({"width": F.when(~F.col("bar"), DELIVERY_FIELDS).otherwise(F.coalesce("width", F.lit(len(BAR_COLUMNS))))} | standard)


def _field(fields: Column, name: str) -> Column:
    """A bar line's field by its file's own header."""
    return _trimmed(F.get(fields, F.col(f"at_{name}") - 1))


def _checks(fields: Column) -> dict[str, Column]:
    """Validity of each checked field; true where it does not apply."""
    return {
        "tottrdqty": F.when(F.col("bar"), valid_quantity(_field(fields, "TOTTRDQTY"))).otherwise(True),
        "timestamp": F.when(F.col("bar"), real_date(_field(fields, "TIMESTAMP")).isNotNull()).otherwise(True),
        "deliv_per": F.when(~F.col("bar"), valid_percentage(_trimmed(F.get(fields, F.lit(6))), _trimmed(F.get(fields, F.lit(3))))).otherwise(True),
    }


def _offset(df: DataFrame) -> DataFrame:
    """Adds the line's offset: its id and a hash of file, number and text (ids alone may repeat)."""
    return df.withColumn("offset_hash", F.xxhash64("file_name", "line_no", "raw"))


def _conforming(shape: Column) -> Column:
    ok = shape["good_quotes"] & (F.size(shape["fields"]) == F.col("width"))
    for check in _checks(shape["fields"]).values():
        ok = ok & check
    return ok


def file_day(name: Column) -> Column:
    """Day in a delivery file's name (MTO_ddMMyyyy.DAT), null if it holds none."""
    digits = F.regexp_extract(name, r"MTO_([0-9]{8})\.DAT$", 1)
    return F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2)).try_cast("date")


def strict_load(lines: DataFrame) -> DataFrame:
    """The conforming lines, typed, under their offsets."""
    placed = _offset(with_layout(data_lines(lines), lines)).where(let(shape_of(F.col("raw")), _conforming))
    loaded = placed.withColumn("fields", shape_of(F.col("raw"))["fields"])
    fields = F.col("fields")

    def delivery(i: int) -> Column:
        return _trimmed(F.get(fields, F.lit(i)))

    bar = F.col("bar")
    return loaded.select(
        "line_id", "file_name", "line_no", "offset_hash",
        F.when(bar, "bar").otherwise("delivery").alias("file_kind"),
        F.when(bar, _field(fields, "SYMBOL")).otherwise(delivery(2)).alias("symbol"),
        F.when(bar, _field(fields, "SERIES")).otherwise(delivery(3)).alias("series"),
        *[F.when(bar, _field(fields, header).try_cast("double")).alias(name) for name, header in _NUMBERS.items()],
        F.when(bar, _field(fields, "TOTTRDQTY")).otherwise(delivery(4)).try_cast("bigint").alias("quantity"),
        F.when(bar, real_date(_field(fields, "TIMESTAMP"))).otherwise(file_day(F.col("file_name"))).alias("day"),
        F.when(~bar, delivery(5).try_cast("bigint")).alias("delivered"),
        F.when(~bar, delivery(6).try_cast("double")).alias("delivered_pct"),
    )


def rejects(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, line_no, raw, reason): raw offsets less loaded ones, diagnosed."""
    loaded = strict_load(lines).select(F.col("line_id").alias("loaded_id"), F.col("offset_hash").alias("loaded_hash"))
    raw = _offset(data_lines(lines))
    same = F.col("line_id").eqNullSafe(F.col("loaded_id")) & (F.col("offset_hash") == F.col("loaded_hash"))
    # only offsets are shuffled; the remainder's are small and find their lines in a second scan
    offsets = raw.select("line_id", "offset_hash").join(loaded, same, "left_anti").distinct()
    apart = materialise(offsets, "offsets").withColumnsRenamed({"line_id": "loaded_id", "offset_hash": "loaded_hash"})
    rest = raw.join(apart, same, "left_semi")
    left = with_layout(rest, lines).withColumn("shape", shape_of(F.col("raw"))).withColumns({"good_quotes": F.col("shape.good_quotes"), "fields": F.col("shape.fields")})
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(reason)) for reason, ok in _checks(F.col("fields")).items()]))
    reasons = (
        F.when(~F.col("good_quotes"), F.array(F.lit("quoting")))
        .when(F.size("fields") != F.col("width"), F.array(F.lit("column_count")))
        .otherwise(failed)
    )
    return left.select("line_id", "file_name", "line_no", "raw", F.explode(reasons).alias("reason"))
