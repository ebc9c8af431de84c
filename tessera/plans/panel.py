"""Customer panel tables: cleaned customers, vectors with past states, new products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.operators.fills import ages_to_usual, fill_group_median, fill_minimum
from tessera.operators.frames import code_lookup
from tessera.session import cut_lineage

# Code, code of a blank cell. Country and channel codes are passed in by the caller.
CODE_TABLES = {
    "ind_empleado": ({"N": 1, "B": 2, "F": 3, "A": 4, "S": 5}, 0),
    "sexo": ({"V": 0, "H": 1}, 2),
    "ind_nuevo": ({"0": 0, "1": 1}, 1),
    "indrel": ({"1": 0, "99": 1}, 1),
    "indrel_1mes": ({"1.0": 1, "1": 1, "2.0": 2, "2": 2, "3.0": 3, "3": 3, "4.0": 4, "4": 4, "P": 5}, 0),
    "tiprel_1mes": ({"I": 1, "A": 2, "P": 3, "R": 4, "N": 5}, 0),
    "indresi": ({"S": 1, "N": 2}, 0),
    "indext": ({"S": 1, "N": 2}, 0),
    "indfall": ({"S": 1, "N": 2}, 0),
    "ind_actividad_cliente": ({"0": 0, "1": 1}, 2),
    "segmento": ({"02 - PARTICULARES": 0, "03 - UNIVERSITARIO": 1, "01 - TOP": 2}, 3),
}


def clean_customers(df: DataFrame) -> DataFrame:
    """Impute age, seniority, income and codes; input columns as in the bank panel."""
    out = cut_lineage(ages_to_usual(df, "age"))
    out = fill_minimum(out, "antiguedad").withColumn("antiguedad", F.greatest("antiguedad", F.lit(0.0)))
    out = out.fillna({"ind_nuevo": "1", "ind_actividad_cliente": "1", "sexo": "UNKNOWN", "nomprov": "UNKNOWN"})
    out = out.withColumn("indrel_1mes", F.when(F.coalesce("indrel_1mes", F.lit("")) == "", "1").when(
        F.col("indrel_1mes") == "P", "5").otherwise(F.col("indrel_1mes")).cast("double").cast("int"))
    return fill_group_median(out, "nomprov", "renta")


def customer_vectors(
    panel: DataFrame, customers: DataFrame, products: Sequence[str], time: str, now: int,
    lags: Sequence[int], income_by_place: Mapping[str, float], income_default: float,
    more_codes: Mapping[str, tuple[Mapping, int]] | None = None,
) -> DataFrame:
    """One row per customer seen at ``now``: codes, scaled numbers, past states, totals.

    ``more_codes`` adds code tables (codes, code of a blank or unknown cell), as for country and channel.
    """
    state = [
        F.coalesce(F.max(F.when(F.col(time) == now - k, F.col(p))), F.lit(0)).alias(f"{p}_{k}")
        for k in (0, *lags) for p in products
    ]
    states = panel.groupBy("ncodpers").agg(F.max((F.col(time) == now).cast("int")).alias("__now"), *state).where("__now = 1")
    place = F.create_map(*[F.lit(x) for kv in income_by_place.items() for x in kv])
    income = F.coalesce(F.col("renta"), place[F.col("nomprov")], F.lit(income_default))
    codes = [
        code_lookup(F.col(c), table, missing, missing).alias(f"{c}_code")
        for c, (table, missing) in {**CODE_TABLES, **(more_codes or {})}.items() if c in customers.columns
    ]
    sex = F.coalesce(F.col("sexo"), F.lit("N"))
    active = F.coalesce(F.col("ind_actividad_cliente"), F.lit("N"))
    new_code = code_lookup(F.col("ind_nuevo"), *CODE_TABLES["ind_nuevo"], 1)
    segment = code_lookup(F.col("segmento"), *CODE_TABLES["segmento"], 3)
    rows = customers.select(
        "ncodpers", *codes,
        C.clip_scale(F.col("age"), 18.0, 100.0, 40.0).alias("age_scaled"),
        C.clip_scale(F.col("antiguedad"), 0.0, 256.0, 0.0).alias("seniority_scaled"),
        C.clip_scale(income, 0.0, 1500000.0, income_default, 6).alias("income_scaled"),
        C.age_group(F.col("age")).alias("age_group"), C.seniority_group(F.col("antiguedad")).alias("seniority_group"),
        C.income_group(income).alias("income_group"),
        C.marriage_index(F.coalesce(F.col("age"), F.lit(40.0)), sex, income).alias("marriage"),
        C.pair_code(F.concat(sex, active), C.SEX_ACTIVITY).alias("sex_activity"),
        C.pair_code(new_code + segment * 10, C.NEW_SEGMENT).alias("new_segment"),
        C.month_or_hash(F.col("fecha_alta"), F.col("ncodpers")).alias("join_month"),
    )
    before = lags[0]
    total = sum((F.col(f"{p}_{before}") for p in products), F.lit(0))
    return rows.join(states.drop("__now"), "ncodpers").withColumn("total_before", total)


def new_product_rows(vectors: DataFrame, products: Sequence[str], lag: int = 1) -> DataFrame:
    """Repeat each customer once per product held now but not ``lag`` steps back."""
    added = F.array(*[
        F.when(F.greatest(F.col(f"{p}_0") - F.col(f"{p}_{lag}"), F.lit(0)) > 0, F.lit(i)) for i, p in enumerate(products)
    ])
    return vectors.withColumn("label", F.explode(F.filter(added, lambda x: x.isNotNull())))
