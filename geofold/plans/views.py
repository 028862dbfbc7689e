"""Input tables derived from the given ones.

Each text runs in Spark and in ANSI SQL engines alike; ``{table}`` marks a base table, ``{{view}}`` is not used:
views build on base tables and on views listed in ``uses``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = " ".join(sql.split())


view("dem_cell", """
    select 'R0' region, cast(floor(o_orderkey/125e0) as bigint) r, cast(o_orderkey % 125 as bigint) c,
           o_totalprice/1000e0 z from orders""")
view("position", """
    select event_id, user_id peer, ts, event_id lamport, -27.6e0 + (user_id % 20)*0.01e0 + value*0.0001e0 lat,
           153e0 + (event_id % 97)*0.002e0 lon, value alt,
           case event_type when 'view' then 'walk' when 'click' then 'fly' else 'stand' end mode from events""")
view("op_log", """
    select event_id op_id, user_id author, cast(floor(event_id/3e0) as bigint) lamport, user_id % 10 vx,
           cast(floor(value) as bigint) % 10 vy, event_id % 5 vz,
           case event_type when 'view' then 'STONE' when 'click' then 'DIRT' when 'purchase' then 'GRASS'
                when 'signup' then 'WATER' else 'AIR' end material, ts from events""")
view("node", """
    select p_partkey node_id, -27.5e0 + (p_partkey % 100)*0.0005e0 lat, 153e0 + floor(p_partkey/100e0)*0.0005e0 lon,
           p_type kind, p_size size_no from part""")
view("way_node", """
    select l_orderkey way_id, cast(row_number() over (partition by l_orderkey
             order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) as bigint) seq, l_partkey node_id
    from lineitem""")
view("way_tag", """
    select o_orderkey way_id, case o_orderpriority when '1-URGENT' then 'motorway' when '2-HIGH' then 'primary'
           when '3-MEDIUM' then 'residential' when '4-NOT SPECIFIED' then 'footway' else 'track' end highway,
           o_orderstatus status from orders""")
view("key_record", """
    select o_custkey peer, o_orderdate updated_at, o_orderkey seq,
           case c_mktsegment when 'BUILDING' then 'User' when 'AUTOMOBILE' then 'Business' when 'MACHINERY' then 'Relay'
                when 'HOUSEHOLD' then 'Guest' else 'Admin' end key_type, o_orderstatus='F' revoked
    from orders join customer on o_custkey=c_custkey""")
view("rtt", """
    select l_suppkey link, cast(row_number() over (partition by l_suppkey
             order by l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity) as bigint) seq,
           l_quantity*2e0 rtt_ms from lineitem""")
view("site", """
    select s_suppkey site_id, s_nationkey category, -27.6e0 + (s_suppkey % 23)*0.01e0 + s_nationkey*0.0003e0 lat,
           153e0 + (s_suppkey % 19)*0.01e0 + s_nationkey*0.0002e0 lon, s_acctbal alt from supplier""")
# Irregular pentagons around the sites; the ring does not repeat its first point.
view("poly_vertex", """
    select site_id poly_id, category, cast(k as bigint) seq,
           lat + 0.004e0*(case k when 1 then -1e0 when 2 then -0.7e0 when 3 then 0.4e0 when 4 then 1e0 else 0.1e0 end) lat,
           lon + 0.004e0*(case k when 1 then -0.8e0 when 2 then 0.9e0 when 3 then 0.3e0 when 4 then 0.7e0 else -1e0 end) lon
    from site join (select 1 k union all select 2 union all select 3 union all select 4 union all select 5) ks on true""")
# Four-node lines through the sites.
view("line_vertex", """
    select site_id line_id, category, cast(k as bigint) seq,
           lat + 0.003e0*(k - 2.5e0) + 0.0004e0*(site_id % 3) lat,
           lon + 0.002e0*(case k when 1 then -1e0 when 2 then 0.5e0 when 3 then -0.2e0 else 1.1e0 end) lon,
           alt/100e0 + 10e0*(4-k) elev
    from site join (select 1 k union all select 2 union all select 3 union all select 4) ks on true""")


def uses(name: str) -> list[str]:
    """Views a view's text refers to."""
    return [v for v in VIEWS if v != name and re.search(rf"\b(from|join)\s+{v}\b", VIEWS[name])]


def with_views(sql: str) -> str:
    """Prefix a query with the CTEs of the views it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b(from|join)\s+{v}\b", text, re.I) and v not in order:
                need(VIEWS[v])
                if v not in order:
                    order.append(v)

    need(sql)
    body = sql.strip()
    ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in order)
    if not ctes:
        return body
    lowered = body.lower()
    if lowered.startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    if lowered.startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


class Inputs:
    """Base tables and derived views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in VIEWS:
                self._seen[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL over base tables and views, bound as DataFrames."""
        names = {n for n in [*TABLES, *VIEWS] if re.search(rf"\b(from|join)\s+{n}\b", text)}
        bound = re.sub(
            rf"\b(from|join)\s+({'|'.join(sorted(names)) or '#'})\b", lambda m: f"{m[1]} {{{m[2]}}}", text
        )
        return self.spark.sql(bound, **{n: getattr(self, n) for n in names})

    @cached_property
    def polygons(self) -> DataFrame:
        """``(poly_id, category, polygon)`` from the vertices of the sites."""
        return self._geometry(self.poly_vertex, ["poly_id", "category"], "polygon")

    @cached_property
    def lines(self) -> DataFrame:
        return self._geometry(self.line_vertex, ["line_id", "category"], "line")

    @staticmethod
    def _geometry(vertices: DataFrame, keys: list[str], out: str) -> DataFrame:
        from ..operators.features import gather_points

        return gather_points(vertices, keys, "seq", out)
