"""Price, index and action files: scans that set bad rows aside with a reason, and sinks that can be run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Column names of the two price-file layouts, in the order symbol, series, isin, open, high, low, close, volume, date, with the date's form.
OLD = ("SYMBOL", "SERIES", "ISIN", "OPEN", "HIGH", "LOW", "CLOSE", "TOTTRDQTY", "TIMESTAMP", "dd-MMM-yyyy")
NEW = ("TckrSymb", "SctySrs", "ISIN", "OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol", "TradDt", "yyyy-MM-dd")
NAMES = ("symbol", "series", "isin", "open", "high", "low", "close", "volume")


def try_double(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS double)")


def price_files(spark: SparkSession, path: str, layout: tuple[str, ...], trade_date: str, series: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, skipped) of a day's files.

    A row of another day, without numbers, with prices out of order or that repeats a (symbol, series) is a reject with its reason;
    rows of other series are counted and skipped.
    """
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in layout[:9])).csv(path)
    rows = raw.select(*[(F.trim(F.col(c)) if n in NAMES[:3] else try_double(c)).alias(n) for c, n in zip(layout[:8], NAMES, strict=True)], F.expr(f"try_to_date(`{layout[8]}`, '{layout[9]}')").alias("trade_date"))
    wanted = F.col("series").isin(series)
    skipped = rows.where(~wanted).groupBy("series").agg(F.count("*").alias("n"))
    seen = F.row_number().over(W.partitionBy("symbol", "series").orderBy(*[F.col(n) for n in NAMES[2:]]))
    rows = rows.where(wanted).withColumn("copy", seen)
    prices = [F.col(n) for n in ("open", "high", "low", "close")]
    missing = F.coalesce(*[F.when(p.isNull() | (p <= 0), F.lit(True)) for p in prices], F.lit(False))
    reason = (
        F.when(~F.col("trade_date").eqNullSafe(F.lit(trade_date).cast("date")), "WRONG_DATE").when(missing, "NO_PRICE")
        .when((F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")), "PRICE_ORDER").when(F.col("volume") < 0, "VOLUME").when(F.col("copy") > 1, "REPEATED")
    )
    rows = rows.withColumn("reason", reason).drop("copy")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL"), skipped


#: The header of an index file, and how the ISIN of a fund's units begins.
INDEX_HEADER, UNIT_ISIN = "Index Name,Index Date,Closing Index Value,Volume", "INF"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_day, line) of a folder of text files that have their day in their name, as yyyy-MM-dd."""
    day = F.expr("try_to_date(regexp_extract(_metadata.file_name, '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0), 'yyyy-MM-dd')")
    return spark.read.text(path).select(day.alias("file_day"), F.col("value").alias("line"))


def checked(lines: DataFrame, header: Column, columns: str, day: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their file's state, files(file_day, state, n_lines)) of lines(file_day, line).

    A file is BAD_HEADER unless just one of its lines is the header, and WRONG_DATE if a line is of another day than the file or of none;
    such a file is refused as a whole. Blank lines and files without a day are left out. day reads the fields in `c`.
    """
    rows = lines.where(F.col("file_day").isNotNull() & (F.trim("line") != "")).withColumn("head", F.trim("line") == header).withColumn("c", F.from_csv("line", columns)).withColumn("day", day)
    per = rows.groupBy("file_day").agg(F.count_if("head").alias("heads"), F.count_if(~F.col("head") & ~F.col("day").eqNullSafe(F.col("file_day"))).alias("off"), F.count_if(~F.col("head")).alias("n_lines"))
    state = F.when(F.col("heads") != 1, "BAD_HEADER").when(F.col("off") > 0, "WRONG_DATE").otherwise("OK")
    files = per.select("file_day", state.alias("state"), "n_lines")
    return rows.where(~F.col("head")).drop("head", "line").join(files.select("file_day", "state"), "file_day"), files


def price_days(lines: DataFrame, switch_day: str, series: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, files) of the lines(file_day, line) of daily price files; see checked() for files that are refused.

    Files before switch_day have the OLD layout, all others the NEW one. Units of funds and other series are counted and skipped; a row
    without prices, with prices out of order, with a volume below zero, or that repeats a (symbol, series) of its file is a reject with its reason.
    files: file_day, state, n_lines, n_rows, n_rejects, n_skipped, n_units; the last four are null for a refused file.
    """
    old = F.col("file_day") < F.lit(switch_day).cast("date")
    columns = ", ".join(f"{n} string" for n in (*NAMES, "day"))
    day = F.when(old, F.expr(f"try_to_date(c.day, '{OLD[9]}')")).otherwise(F.expr(f"try_to_date(c.day, '{NEW[9]}')"))
    every, files = checked(lines, F.when(old, ",".join(OLD[:9])).otherwise(",".join(NEW[:9])), columns, day)
    text, number = ("symbol", "series", "isin"), NAMES[3:]
    rows = every.where("state = 'OK'").select("file_day", *[F.trim(F.col(f"c.{n}")).alias(n) for n in text], *[F.col(f"c.{n}").try_cast("double").alias(n) for n in number])
    unit, wanted = F.coalesce(F.col("isin").startswith(UNIT_ISIN), F.lit(False)), F.coalesce(F.col("series").isin(series), F.lit(False))
    rows = rows.withColumn("kind", F.when(unit, "UNIT").when(~wanted, "SERIES").otherwise("ROW"))
    copy = F.row_number().over(W.partitionBy("file_day", "symbol", "series", "kind").orderBy(*NAMES[2:]))
    missing = F.coalesce(*[F.when(F.col(p).isNull() | (F.col(p) <= 0), F.lit(True)) for p in ("open", "high", "low", "close")], F.lit(False))
    reason = (
        F.when(F.col("kind") != "ROW", None).when(missing, "NO_PRICE").when((F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")), "PRICE_ORDER")
        .when(F.col("volume") < 0, "VOLUME").when(copy > 1, "REPEATED")
    )
    rows = rows.withColumn("reason", reason)
    n = lambda test: F.count_if(test)
    counts = rows.groupBy("file_day").agg(n((F.col("kind") == "ROW") & F.col("reason").isNull()).alias("n_rows"), n(F.col("reason").isNotNull()).alias("n_rejects"), n(F.col("kind") == "SERIES").alias("n_skipped"), n(F.col("kind") == "UNIT").alias("n_units"))
    good = rows.where("kind = 'ROW' AND reason IS NULL").drop("kind", "reason")
    return good, rows.where("reason IS NOT NULL").drop("kind"), files.join(counts, "file_day", "left")


def index_closes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of the lines(file_day, line) of daily index files: name, day, close, volume; '-' is missing. Files are refused as checked() says."""
    every, files = checked(lines, F.lit(INDEX_HEADER), "name string, day string, close string, volume string", F.expr("try_to_date(c.day, 'dd-MM-yyyy')"))
    rows = every.where("state = 'OK'").select(F.trim("c.name").alias("name"), "day", *[F.col(f"c.{x}").try_cast("double").alias(x) for x in ("close", "volume")])
    return rows, files


def parse_actions(text: Column) -> Column:
    """What an announcement says: (kind, num, den, price). Kinds: BONUS, SPLIT, RIGHTS, DIVIDEND, UNMODELLED, OTHER.

    A text with two different ratios is ambiguous and has none. A rights price is face value and premium, or par.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    ratio = r"(\d+)\s*:\s*(\d+)"
    kind = (
        F.when(t.rlike(r"demerger|amalgamation|capital reduction|scheme"), "UNMODELLED").when(t.rlike("bonus"), "BONUS").when(t.rlike(r"split|sub-?division"), "SPLIT")
        .when(t.rlike("rights"), "RIGHTS").when(t.rlike("dividend"), "DIVIDEND").otherwise("OTHER")
    )
    both = F.regexp_extract_all(t, F.lit(ratio), F.lit(0))
    alone = F.size(F.array_distinct(both)) == 1
    faces = r"from\s+rs\.?\s*(\d+).*?to\s+rs?e?\.?\s*(\d+)"
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    number = lambda c: F.when(c != "", c.cast("int"))
    split = kind == "SPLIT"
    num = F.when(split, number(part(faces, 1))).when(alone & kind.isin("BONUS", "RIGHTS"), number(part(ratio, 1)))
    den = F.when(split, number(part(faces, 2))).when(alone & kind.isin("BONUS", "RIGHTS"), number(part(ratio, 2)))
    premium = number(F.regexp_extract(t, r"premium\s+(?:of\s+)?rs\.?\s*(\d+)", 1))
    face = number(F.regexp_extract(t, r"face value\s+(?:of\s+)?rs\.?\s*(\d+)", 1))
    price = F.when(kind == "RIGHTS", F.when(premium.isNotNull(), premium + F.coalesce(face, F.lit(0))).when(t.contains("at par"), face))
    return F.struct(kind.alias("kind"), num.alias("num"), den.alias("den"), price.alias("price"))


def with_source_hash(rows: DataFrame) -> DataFrame:
    """Rows with a hash over all their columns, nulls marked: the same row always has the same hash."""
    return rows.withColumn("source_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(rows.columns)]), 256))


def append_landing(rows: DataFrame, path: str) -> None:
    with_source_hash(rows).write.mode("append").parquet(path)


def export_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a column, replaced as a whole; folders of other values stay."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Union of both, the row with the greatest order for each key, new before old where equal."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*key).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def missing_days(have: DataFrame, start: str, end: str, settle: int, holidays: DataFrame) -> DataFrame:
    """(day, state) of weekdays without a file: HOLIDAY, NO_SESSION once `settle` days have passed, PENDING before."""
    days = have.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")).where(F.weekday("day") < 5)
    gone = days.join(have.select("day"), "day", "left_anti").join(holidays.select("day", F.lit(True).alias("off")), "day", "left")
    return gone.select("day", F.when(F.col("off"), "HOLIDAY").when(F.datediff(F.lit(end).cast("date"), "day") >= settle, "NO_SESSION").otherwise("PENDING").alias("state"))
