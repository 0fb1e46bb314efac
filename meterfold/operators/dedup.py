"""Keep-one-per-key operators.

``row_number() = 1`` lets Spark cut every key to one row per map task before the shuffle
(window group limit), so a key that holds a large share of the rows moves one row per task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def latest_right_order(arrival: str) -> list[Column]:
    """Latest start date, then latest creation date, then first arrived; null and blank lowest."""
    blank = F.lit("")
    return [
        F.coalesce("date_debut_droit_acces", blank).desc(),
        F.coalesce("date_creation", blank).desc(),
        F.col(arrival).asc(),
    ]


def latest_rights(records: DataFrame, key: str = "id_pce", arrival: str = "input_ord") -> DataFrame:
    """Latest right per meter, dates compared as text.

    Rows without an id are all kept; their (unique) arrival number becomes their group so that
    they stay spread over the cluster.
    """
    missing = F.coalesce(F.col(key), F.lit("")) == ""
    return keep_first(
        records, [F.col(key), F.when(missing, F.col(arrival))], latest_right_order(arrival))


def last_arrived(df: DataFrame, keys: list[str], arrival: str, null_safe: bool = False) -> DataFrame:
    """Last arrival per key; rows with a null key part never equal each other unless asked."""
    parts = [F.col(k) for k in keys]
    if not null_safe:
        any_null = F.lit(False)
        for part in parts:
            any_null = any_null | part.isNull()
        parts.append(F.when(any_null, F.col(arrival)))
    return keep_first(df, parts, [F.col(arrival).desc()])
