"""Vendor identity and shop owners by lookup in small configured maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.texts import default_vendor_id, normalize_vendor


def vendor_identity(names: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """``names`` (vendor_name, ...) with vendor_id: the alias that equals the normalised name, else the default id."""
    spark = names.sparkSession
    known = spark.createDataFrame([(v, a) for v, spellings in aliases.items() for a in spellings], "known_id string, alias string")
    known = known.select("known_id", normalize_vendor(F.col("alias")).alias("alias_key")).dropDuplicates(["alias_key"])
    joined = names.join(F.broadcast(known), normalize_vendor(F.col("vendor_name")) == F.col("alias_key"), "left")  # a configured map
    return joined.select(*names.columns, F.coalesce("known_id", default_vendor_id(F.col("vendor_name"))).alias("vendor_id"))


def shop_owner(shops: DataFrame, owners: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """``shops`` (shop, ...) with owner: ``Name <email>``, whichever of the two is known, or null."""
    spark = shops.sparkSession
    known = spark.createDataFrame([(s, n, m) for s, (n, m) in owners.items()], "known_shop string, name string, email string")
    joined = shops.join(F.broadcast(known), F.col("shop") == F.col("known_shop"), "left")  # a configured map
    both = F.col("name").isNotNull() & F.col("email").isNotNull()
    owner = F.when(both, F.concat("name", F.lit(" <"), "email", F.lit(">"))).otherwise(F.coalesce("name", "email"))
    return joined.select(*shops.columns, owner.alias("owner"))
