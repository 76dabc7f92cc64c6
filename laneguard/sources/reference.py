"""Reference network files: ports, waypoints, legs and lanes as CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard import schemas
from laneguard.operators.integrity import violations


@dataclass(frozen=True)
class Reference:
    ports: DataFrame
    waypoints: DataFrame
    legs: DataFrame
    lanes: DataFrame

    def nodes(self) -> DataFrame:
        """Ports and waypoints as one node table."""
        port = self.ports.select("node_id", "name", F.lit("port").alias("kind"), "lat", "lon", "country_code", "region")
        way = self.waypoints.select("node_id", "name", "kind", "lat", "lon", F.lit(None).cast("string").alias("country_code"), F.lit(None).cast("string").alias("region"))
        return port.unionByName(way)

    def violations(self) -> DataFrame:
        return violations(self.ports, self.waypoints, self.legs, self.lanes)


def split_aliases(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), F.trim), lambda a: a != "")


def load_reference(spark: SparkSession, folder: str, check: bool = True) -> Reference:
    """Typed reference tables. With ``check`` the first violation of the cross-file rules raises."""
    read = lambda name, schema: spark.read.schema(schema).option("header", "true").csv(f"{folder}/{name}.csv")
    ref = Reference(
        read("ports", schemas.PORTS).withColumnRenamed("locode", "node_id").withColumn("aliases", split_aliases(F.col("aliases"))),
        read("waypoints", schemas.WAYPOINTS).withColumn("aliases", split_aliases(F.col("aliases"))),
        read("sea_legs", schemas.LEGS), read("lanes", schemas.LANES),
    )
    if check:
        bad = ref.violations().limit(1).collect()
        if bad:
            raise ValueError(f"reference data: {bad[0].rule} at {bad[0].key} {bad[0].detail}".strip())
    return ref


def save_reference(nodes: DataFrame, legs: DataFrame, lanes: DataFrame, folder: str) -> None:
    write = lambda df, name: df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")
    write(nodes.filter("kind = 'port'").select(F.col("node_id").alias("locode"), "name", "country_code", "region", "lat", "lon", "aliases"), "ports")
    write(nodes.filter("kind <> 'port'").select("node_id", "name", "kind", "lat", "lon", "country_code", "aliases"), "waypoints")
    write(legs, "sea_legs")
    write(lanes.select("lane_id", "origin", "destination", "focus"), "lanes")


def listing(ref: Reference) -> DataFrame:
    """part, id, name, extra, lat, lon of everything in the reference."""
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    cols = lambda part, i, n, e, a, b: [F.lit(part).alias("part"), i.alias("id"), n.alias("name"), e.alias("extra"), a.alias("lat"), b.alias("lon")]
    c = F.col
    return (
        ref.ports.select(*cols("port", c("node_id"), c("name"), c("region"), c("lat"), c("lon")))
        .unionByName(ref.waypoints.select(*cols("waypoint", c("node_id"), c("name"), c("kind"), c("lat"), c("lon"))))
        .unionByName(ref.legs.select(*cols("leg", c("from_node"), c("to_node"), blank, none, none)))
        .unionByName(ref.lanes.select(*cols("lane", c("lane_id"), c("origin"), c("destination"), none, none)))
    )
