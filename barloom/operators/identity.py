"""Who an instrument is over the days: links of identifiers, merged to one id, its first code, by rounds of least labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.streaming import scratch


def identifier_links(days: DataFrame, prefix: int = 9, issuer: Column | None = None) -> DataFrame:
    """(a, b): codes of one instrument. days(code, symbol, day); the issuer is the first `prefix` letters of a code, or a column of it.

    b's first day follows a's last with the same symbol and issuer, or b continues the serial of a renamed symbol.
    """
    rows = days.select("code", "symbol", "day", (F.substring("code", 1, prefix) if issuer is None else issuer).alias("issuer")).distinct()
    span = rows.groupBy("code", "symbol", "issuer").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    w = W.partitionBy("symbol", "issuer").orderBy("first", "code")
    same = span.select(F.lag("code").over(w).alias("a"), F.col("code").alias("b"), F.lag("last").over(w).alias("ended"), "first").where(F.col("a").isNotNull() & (F.col("a") != F.col("b")) & (F.col("ended") < F.col("first"))).select("a", "b")
    return same.unionByName(continued_serials(rows)).distinct()


def continued_serials(rows: DataFrame) -> DataFrame:
    """(a, b): a new code b under a new symbol, and the one open code a of its issuer with a lower serial whose symbol isn't traded that day.

    rows(code, symbol, day, issuer). What is open depends on the links before, so the days of an issuer are replayed in order; only
    issuers with several symbols can have such a link, and others are not replayed. A day's symbols are those of all issuers.
    """
    several = rows.groupBy("issuer").agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi")).where(F.col("lo") != F.col("hi")).select("issuer")
    symbols = rows.join(several, "issuer").select(F.col("issuer").alias("of"), "symbol").distinct()
    days = rows.join(symbols, "symbol").select("of", "code", "symbol", "day", (F.col("issuer") == F.col("of")).alias("own"), F.expr("substring(code, length(issuer) + 1, 2)").alias("serial"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, current, out = {}, {}, []  # code -> instrument; instrument -> (symbol, code, serial, since)
        for day, group in pdf.groupby("day", sort=True):
            today = set(group["symbol"])
            own = group[group["own"]]
            for new, symbol, code, serial in sorted((c not in owner, s, c, n) for s, c, n in zip(own["symbol"], own["code"], own["serial"], strict=True)):
                i = owner.get(code) if new else owner[code]
                if i is None:
                    same = [k for k, v in current.items() if v[0] == symbol]
                    moved = [k for k, v in current.items() if v[0] not in today and serial > v[2]]
                    if len(same) == 1:
                        i = same[0]
                    elif not same and len(moved) == 1:
                        i = moved[0]
                        out.append((current[i][1], code))
                    else:
                        i = len(current)
                    owner[code] = i
                if i not in current or current[i][:2] != (symbol, code) and current[i][3] != day:
                    current[i] = (symbol, code, serial, day)
        return pd.DataFrame(out, columns=["a", "b"])

    return days.groupBy("of").applyInPandas(replay, "a string, b string")


def resolve(links: DataFrame) -> DataFrame:
    """(code, id): for each code of links(a, b), the first code of all that hang together: the least that no link leads to.

    Where links go round, the least code stands. Alternates two steps until nothing changes, whatever the length of a chain: every code's larger neighbours are linked to the least
    code around it, then its smaller ones. Each step is written to the shared folder.
    """
    spark = links.sparkSession
    at, n = scratch(spark), iter(range(1 << 30))
    links = stored(links, at, n)
    later = links.where(F.col("a") != F.col("b")).select(F.col("b").alias("code")).distinct()
    links = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), at, n)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), at, n)
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where(F.col("a") != F.col("b")).distinct(), at, n)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), at, n)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = stored(small.where(F.col("a") != F.col("b")).distinct(), at, n)
        # Done when every code has one smaller neighbour that has none itself.
        if links.groupBy("a").count().where("count > 1").isEmpty() and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    stars = links.select(F.col("a").alias("code"), F.col("b").alias("least"))
    stars = stored(stars.unionByName(links.select(F.col("b").alias("code"), F.col("b").alias("least")).distinct()), at, n)
    heads = stars.join(later, "code", "left_anti").groupBy("least").agg(F.min("code").alias("head"))
    return stars.join(heads, "least", "left").select("code", F.coalesce("head", "least").alias("id"))


def stored(df: DataFrame, at: str, n: Iterator[int]) -> DataFrame:
    """The frame written to the next folder of `at` and read again."""
    path = f"{at}/links-{next(n)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def periods(days: DataFrame) -> DataFrame:
    """(id, code, valid_from, valid_to, reason): runs of days of an id under one code. days(id, code, day)."""
    w = W.partitionBy("id").orderBy("day")
    rows = days.withColumn("new", F.when(F.lag("code").over(w).eqNullSafe(F.col("code")), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy("id", "run", "code").agg(F.min("day").alias("valid_from"))
    v = W.partitionBy("id").orderBy("run")
    return runs.select("id", "code", "valid_from", F.lead("valid_from").over(v).alias("valid_to"), F.when(F.lag("code").over(v).isNull(), "FIRST").otherwise("CODE_CHANGE").alias("reason"))
