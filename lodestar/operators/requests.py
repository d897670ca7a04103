"""Accounts, requests and their figures: upserts, transitions, readiness, routing, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest lacks, or has with another time or length."""
    return listing.join(manifest, ["path", "mtime", "length"], "left_anti")


def files_with_prefix(listing: DataFrame, prefix: str) -> DataFrame:
    """S7"""
    return listing.where(F.col("path").startswith(prefix))


def signature(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stale(inputs: DataFrame, outputs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Inputs whose signature differs from the one stored with the output (key, sig), or that have no output."""
    now = inputs.withColumn("_sig", signature(columns))
    return now.join(outputs.select(key, "sig"), key, "left").where(~F.col("_sig").eqNullSafe(F.col("sig"))).drop("_sig", "sig")


def upsert(base: DataFrame, updates: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last write of each key."""
    both = base.unionByName(updates)
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, allowed: list[str], state: str, stamp: str, now: Column) -> DataFrame:
    """Only allowed columns change, nulls change nothing; a new state stamps the row."""
    c = changes.select(key, *(F.col(a).alias(f"_{a}") for a in allowed))
    j = base.join(c, key, "left")
    moved = F.col(f"_{state}").isNotNull() & ~F.col(f"_{state}").eqNullSafe(F.col(state)) if state in allowed else F.lit(False)
    return j.select(*(F.coalesce(f"_{n}", n).alias(n) if n in allowed else F.when(moved, now).otherwise(F.col(n)).alias(n) if n == stamp else F.col(n) for n in base.columns))


def same_text(column: str, value: Column) -> Column:
    """Equality whatever the case."""
    return F.lower(column) == F.lower(value)


def without_secrets(df: DataFrame, secret: tuple[str, ...]) -> DataFrame:
    """P12"""
    return df.select(*(c for c in df.columns if c not in secret))


def derived_state(rejection: str, state: str, updated: str, created: str) -> tuple[Column, Column]:
    """The state that counts, and the time of the last change."""
    return F.when(F.col(rejection).isNotNull(), "rechazada").otherwise(F.col(state)), F.coalesce(updated, created)


# What may follow what.
STEPS = (("pendiente", "imprimiendo"), ("imprimiendo", "impreso"))


def legal_moves(spark: SparkSession, asked: DataFrame, state: str, wanted: str, steps=STEPS) -> DataFrame:
    """Adds legal: whether the move is a single step of the table."""
    t = spark.createDataFrame(list(steps), f"{state} string, {wanted} string").withColumn("_ok", F.lit(True))
    return asked.join(F.broadcast(t), [state, wanted], "left").withColumn("legal", F.coalesce("_ok", F.lit(False))).drop("_ok")  # a few steps


def readiness(figures: DataFrame, key: str, removed: Column, error: Column, reviewed: Column, read: Column) -> DataFrame:
    """Why a request can't be approved yet, null if it can: none left, one has an error, not all were read, some are not reviewed."""
    left = ~removed
    g = figures.groupBy(key).agg(F.count_if(left).alias("n"), F.count_if(left & error).alias("e"), F.count_if(left & ~read).alias("u"), F.count_if(left & ~reviewed).alias("p"))
    return g.select(key, F.when(F.col("n") == 0, "ninguna").when(F.col("e") > 0, "error").when(F.col("u") > 0, "sin leer").when(F.col("p") > 0, F.concat_ws(" ", F.lit("faltan"), F.col("p").cast("string"))).alias("motivo"))


def overlaid(elements: DataFrame, edits: DataFrame, keys: list[str], series: list[str], text: str) -> DataFrame:
    """Edits (keys, new_text, hidden) over elements; hidden series go unless that would leave none of the chart."""
    j = elements.join(edits, keys, "left").withColumn(text, F.coalesce("new_text", text))
    any_left = F.max((~F.coalesce("hidden", F.lit(False))).cast("int")).over(Window.partitionBy(*series)) == 1
    return j.withColumn("_left", any_left).where(~(F.coalesce("hidden", F.lit(False)) & F.col("_left"))).drop("new_text", "hidden", "_left")


def capped(df: DataFrame, known: DataFrame, parent: str, file: str, order: str, most: int = 50) -> DataFrame:
    """The first most children of each parent, those with unknown files left out first."""
    ok = df.join(known.select(file).distinct(), file, "left_semi")
    return ok.withColumn("_k", F.row_number().over(Window.partitionBy(parent).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def enriched(df: DataFrame, other: DataFrame, key: str, other_key: str, columns: dict[str, str]) -> DataFrame:
    """Chosen columns of the other table under new names."""
    o = other.select(F.col(other_key).alias("_o"), *(F.col(c).alias(a) for c, a in columns.items()))
    return df.join(o, df[key] == o["_o"], "left").drop("_o")


def routed(requests: DataFrame, people: DataFrame, key: str, person: str, choice: str, fallback: DataFrame, first: str) -> DataFrame:
    """A request goes to its person's choice, else to the first registered."""
    p = people.select(F.col(person).alias("_p"), F.col(choice).alias("_c"))
    least = fallback.agg(F.min(first).alias("_f"))
    return requests.join(p, requests[key] == p["_p"], "left").crossJoin(F.broadcast(least)).withColumn("destino", F.coalesce("_c", "_f")).drop("_p", "_c", "_f")  # one row


def scoped(df: DataFrame, owner: str, value, *order) -> DataFrame:
    """An owner's rows, sorted."""
    return df.where(F.col(owner) == value).orderBy(*order)


def with_fallback(df: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Metadata by file name; what it lacks comes from the row itself."""
    m = meta.select(F.col(key).alias("_m"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = df.join(m, df[key] == m["_m"], "left")
    return j.select(*(c for c in df.columns if c not in columns), *(F.coalesce(f"_{c}", c).alias(c) for c in columns))


def fetched(log: DataFrame, stored: DataFrame, url: str, body: str, status: str, ts: str, most: int, html: Column) -> DataFrame:
    """Of each fetch the body if it is good, else the last stored copy, else the reason why there is none."""
    last = stored.groupBy(url).agg(F.max_by(body, ts).alias("_old"))
    j = log.join(last, url, "left")
    why = F.when(F.col(status).isNull(), "sin respuesta").when(F.col(status) >= 400, F.concat(F.lit("estado "), F.col(status).cast("string"))).when(F.length(body) > most, "grande").when(html, "pagina")
    return j.select(*log.columns, why.alias("_why"), "_old").select(*(c for c in log.columns if c != body), F.when(F.col("_why").isNull(), F.col(body)).otherwise(F.col("_old")).alias(body), F.when(F.col("_why").isNull(), "fresca").when(F.col("_old").isNotNull(), "guardada").otherwise(F.col("_why")).alias("origen"))


def with_defaults(user: DataFrame, defaults: DataFrame, nullable: list[str]) -> DataFrame:
    """(who, key, value) for every default key: the user's value, else the default; a null stays only for keys where it means something."""
    who = user.select("who").distinct()
    full = who.crossJoin(F.broadcast(defaults.withColumnRenamed("value", "_d")))  # one short list of keys
    j = full.join(user.withColumn("_set", F.lit(True)), ["who", "key"], "left")
    return j.select("who", "key", F.when(F.col("_set") & F.col("key").isin(*nullable), F.col("value")).otherwise(F.coalesce("value", "_d")).alias("value"))
