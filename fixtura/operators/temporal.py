"""Joins in time: validity intervals, strict as-of, latest values at a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.shared import small


def mapping_periods(former_names: DataFrame) -> DataFrame:
    """former and its valid periods, in order of (start, end, current). Rows with an empty name, dates that can't
    be read or an inverted period are left out; mapping_issues reports them."""
    rows = former_names.select(F.trim("current_name").alias("current"), F.trim("former").alias("former"), F.trim("start_date").try_cast("date").alias("start"), F.trim("end_date").try_cast("date").alias("end"))
    rows = rows.where("current <> '' and former <> '' and start <= end")
    return rows.groupBy("former").agg(F.sort_array(F.collect_list(F.struct("start", "end", "current"))).alias("periods"))


def mapping_issues(former_names: DataFrame) -> DataFrame:
    """kind and subject of every problem of a name mapping."""
    rows = former_names.select("source_row", F.trim("current_name").alias("current"), F.trim("former").alias("former"), F.trim("start_date").try_cast("date").alias("start"), F.trim("end_date").try_cast("date").alias("end"))
    kind = F.when((F.col("current") == "") | (F.col("former") == ""), "empty_name").when(F.col("start").isNull() | F.col("end").isNull(), "invalid_dates").when(F.col("start") > F.col("end"), "inverted_period")
    marked = rows.withColumn("kind", kind)
    good = marked.where("kind is null")
    order = Window.partitionBy("former").orderBy("start", "end", "current")
    clash = good.select("former", (F.lead("start").over(order) <= F.col("end")).alias("meets"), (F.lead("current").over(order) != F.col("current")).alias("differs"))
    parts = [
        marked.where("kind is not null").select("kind", F.col("source_row").cast("string").alias("subject")),
        clash.where("meets and differs").select(F.lit("overlapping_mapping").alias("kind"), F.col("former").alias("subject")),
        good.select(F.col("former").alias("name")).distinct().join(good.select(F.col("current").alias("name")).distinct(), "name", "left_semi").select(F.lit("chained_mapping").alias("kind"), F.col("name").alias("subject")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def resolve_names(df: DataFrame, periods: DataFrame, date: str, columns: dict[str, str]) -> DataFrame:
    """Add, for each old -> new column, the name current on the row's date: one step, the first period that holds
    the date, both ends included. The mapping is grouped by name, so a lookup never multiplies rows."""
    for old, new in columns.items():
        side = small(periods.select(F.col("former").alias("former_"), F.col("periods").alias("periods_")))
        met = df.join(side, F.trim(old) == F.col("former_"), "left")
        holds = F.filter("periods_", lambda p: (p["start"] <= F.col(date)) & (F.col(date) <= p["end"]))
        df = met.withColumn(new, F.coalesce(F.get(holds, F.lit(0))["current"], F.trim(old))).drop("former_", "periods_")
    return df


def asof_join(facts: DataFrame, states: DataFrame, key: str, fact_date: str, state_date: str, values: list[str], strict: bool = True) -> DataFrame:
    """facts with the values of the latest state of their key before their date (at it too, unless strict).

    Both sides go through one shuffle as one stream per key: at equal dates facts come before states if strict, so
    the last state seen is the one wanted. Memory per key stays constant however long its history is."""
    held = F.struct(F.col(state_date).alias("state_date"), *[F.col(v) for v in values])
    left = facts.select(F.col(key).alias("k_"), F.col(fact_date).alias("t_"), F.lit(0 if strict else 1).alias("o_"), F.lit(None).cast(states.select(held.alias("h")).schema["h"].dataType).alias("h_"), F.struct(*facts.columns).alias("f_"))
    right = states.select(F.col(key).alias("k_"), F.col(state_date).alias("t_"), F.lit(1 if strict else 0).alias("o_"), held.alias("h_"), F.lit(None).cast(left.schema["f_"].dataType).alias("f_"))
    seen = Window.partitionBy("k_").orderBy("t_", "o_").rowsBetween(Window.unboundedPreceding, 0)
    stream = left.unionByName(right).withColumn("h_", F.last("h_", ignorenulls=True).over(seen)).where("f_ is not null")
    return stream.select("f_.*", "h_.state_date", *[F.col(f"h_.{v}").alias(v) for v in values])


def latest_at(df: DataFrame, key: str, date: str, cutoff: Column, values: list[str], tie: str, inclusive: bool = True) -> DataFrame:
    """key and the values of its latest row at (or only before) the cutoff; combined on the map side."""
    past = df.where((F.col(date) <= cutoff) if inclusive else (F.col(date) < cutoff))
    return past.groupBy(key).agg(F.max_by(F.struct(date, *values), F.struct(date, tie)).alias("last")).select(key, "last.*")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a total order."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")
