"""Role views over the given tables, in Spark and in SQL, and the query register."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import DIR8
from ..functions.text import CODES

#: What models say around the letter they mean; in 3, 5, 6 and 10 they mean none.
SAID = (
    "The answer is {}", "Answer: {}", "The answer is a hotel, {}", "The answer is not {}", "A is wrong. {} is correct", "A nice place near the river", "",
    "I think so.\n  {}", "{}. because it is near", "A or B? I would choose {}", "{} isn't right",
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers make(tables) under name; sql may use the SQL views below."""

    def add(make):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return make

    return add


class Tables:
    """The role views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.schemas: dict = {}

    def raw(self, name: str) -> DataFrame:
        """A fresh DataFrame each time, for self-joins; footers are read for the schema once."""
        path = f"{self.dir}/{name}.parquet"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    @cached_property
    def n_customers(self) -> int:
        return self.raw("customer").count()

    @property
    def poi(self) -> DataFrame:
        k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
        c = self.raw("customer").select(
            k.alias("poi_id"),
            F.col("c_name").alias("name"),
            F.concat("c_mktsegment", F.lit(" > S"), (k % 7).cast("string")).alias("category"),
            ((k * k * 31 + k * 7919) % 10007).cast("double").alias("x"),
            ((k * k * 17 + k * 4729 + n * 401) % 10009).cast("double").alias("y"),
        )
        return c.withColumns({"lng": 116.0 + F.col("x") / 100000, "lat": 39.9 + F.col("y") / 100000})

    @property
    def aoi(self) -> DataFrame:
        k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
        a = self.raw("supplier").select(
            k.alias("aoi_id"),
            F.col("s_name").alias("name"),
            ((k * k * 13 + k * 6007 + 13) % 10007).cast("double").alias("cx"),
            ((k * k * 7 + k * 3001 + n * 397 + 29) % 10009).cast("double").alias("cy"),
            F.when(k % 10 == 0, 1200.0).otherwise(350.0).alias("half"),
            F.element_at(F.array(*map(F.lit, CODES)), (n % 14 + 1).cast("int")).alias("land_use"),
        )
        corner = lambda sx, sy: F.struct((F.col("cx") + sx * F.col("half")).alias("x"), (F.col("cy") + sy * F.col("half")).alias("y"))
        return a.withColumn("ring", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))

    @property
    def road(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("road_id"), F.col("p_name").alias("name"))

    @property
    def street(self) -> DataFrame:
        """Roads under names that few of them share."""
        return self.raw("part").select(F.col("p_partkey").alias("road_id"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 40).cast("string")).alias("name"))

    @property
    def lane(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("junction_id"),
            F.col("l_partkey").alias("road_id"),
            F.col("l_suppkey").alias("aoi_id"),
            F.col("l_linenumber").cast("long").alias("no"),
            (F.col("l_quantity") * 20).alias("length"),
        )

    @property
    def lanes(self) -> DataFrame:
        """The lanes with numbers: lane_id, road_id, k (their order on the road), junction_id,
        aoi_id, no, length, and x, y of the junction they belong to."""
        order = Window.partitionBy("road_id").orderBy("junction_id", "no", "aoi_id", "length")
        j = F.col("junction_id")
        lanes = self.lane.withColumn("k", F.row_number().over(order).cast("long"))
        return lanes.withColumns({"lane_id": F.col("road_id") * 1000000 + F.col("k"), "x": ((j * j * 13 + j * 6007) % 10007).cast("double"), "y": ((j * j * 7 + j * 3001) % 10009).cast("double")})

    @property
    def edge(self) -> DataFrame:
        """junction_id, lane_id, way: lane k of a road leads to lane k + 1, through the latter's
        junction, where (road_id + k) % 4 < 2; some lanes so have no neighbour."""
        after = F.lead("junction_id").over(Window.partitionBy("road_id").orderBy("k"))
        links = self.lanes.select("road_id", "k", after.alias("junction_id")).where("junction_id is not null and (road_id + k) % 4 < 2")
        both = F.array(F.struct(F.lit("in").alias("way"), F.col("k")), F.struct(F.lit("out").alias("way"), (F.col("k") + 1).alias("k")))
        met = links.select("road_id", "junction_id", F.explode(both).alias("e"))
        return met.select("junction_id", (F.col("road_id") * 1000000 + F.col("e.k")).alias("lane_id"), "e.way")

    @property
    def position(self) -> DataFrame:
        """Driving positions of the areas: aoi_id, pos, lane_id, s."""
        s = F.col("length") * (F.col("no") % 4 + 1) / 5
        return self.lanes.select("aoi_id", F.struct("junction_id", "no", "road_id", "length", "k").alias("pos"), "lane_id", s.alias("s"))

    @property
    def step(self) -> DataFrame:
        """Route steps: route_id, no, road_id, aoi_id, road_name, road_length, direction."""
        named = self.lane.join(self.road.withColumnRenamed("name", "road_name"), "road_id")
        return named.select(
            F.col("junction_id").alias("route_id"), "no", "road_id", "aoi_id", "road_name", F.floor("length").cast("long").alias("road_length"),
            F.element_at(F.array(*map(F.lit, DIR8)), (F.col("aoi_id") % 8 + 1).cast("int")).alias("direction"),
        )

    @property
    def route(self) -> DataFrame:
        """One row per order: ends, and the steps as an array."""
        s = F.struct(F.col("no"), F.col("road_id"), F.col("aoi_id"), F.lit("road").alias("type"), "road_name", "road_length", "direction", F.lit(None).cast("string").alias("junc_name"))
        steps = self.step.groupBy("route_id").agg(F.array_sort(F.collect_list(s)).alias("steps"))
        n = self.n_customers
        o = self.raw("orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("start_id"), ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % n).alias("dest_id"))
        return o.join(steps, "route_id").withColumn("routes", F.transform("steps", lambda t: F.struct(t["type"].alias("type"), t["road_name"].alias("road_name"), t["road_length"].alias("road_length"), t["direction"].alias("direction"), t["junc_name"].alias("junc_name"))))

    @property
    def visit(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        e = self.raw("events").select(
            F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("traj_id"),
            "user_id", "event_id", "ts", "event_type", k.alias("loc_id"),
            F.when(F.col("user_id") % 2 == 0, "real").otherwise("generated").alias("kind"),
            (F.least(F.col("value"), F.lit(1440.0)) / 1440).alias("duration"),
        )
        order = Window.partitionBy("traj_id").orderBy("ts", "event_id")
        loc = F.col("loc_id")
        return e.withColumns({"seq": F.row_number().over(order).cast("long"), "x": ((loc * loc * 31 + loc * 7919) % 10007).cast("double"), "y": ((loc * loc * 17 + loc * 4729) % 10009).cast("double")})

    @property
    def output(self) -> DataFrame:
        """Model outputs: model, task, event_id, text, answer."""
        e = F.col("event_id")
        said = F.substring(F.lit("ABCDE"), (e % 5 + 1).cast("int"), F.lit(1))
        text = F.element_at(F.array(*[F.replace(F.lit(form), F.lit("{}"), said) for form in SAID]), (e % len(SAID) + 1).cast("int"))
        return self.raw("events").select((F.col("user_id") % 4).alias("model"), F.col("event_type").alias("task"), "event_id", text.alias("text"), F.substring(F.lit("ABCD"), (e % 4 + 1).cast("int"), F.lit(1)).alias("answer"))

    @property
    def dialogue(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", "text")

    @property
    def sft(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "lang", F.col("source").alias("data_source"))


_DIR8 = ",".join(f"'{d}'" for d in DIR8)
_CODES = ",".join(f"'{c}'" for c in CODES)
VIEWS = {
    "poi": """SELECT c_custkey AS poi_id, c_name AS name, concat(c_mktsegment, ' > S', c_custkey % 7) AS category,
  ((c_custkey*c_custkey*31 + c_custkey*7919) % 10007)::DOUBLE AS x, ((c_custkey*c_custkey*17 + c_custkey*4729 + c_nationkey*401) % 10009)::DOUBLE AS y,
  116.0::DOUBLE + ((c_custkey*c_custkey*31 + c_custkey*7919) % 10007)::DOUBLE/100000 AS lng, 39.9::DOUBLE + ((c_custkey*c_custkey*17 + c_custkey*4729 + c_nationkey*401) % 10009)::DOUBLE/100000 AS lat FROM customer""",
    "aoi": f"""SELECT s_suppkey AS aoi_id, s_name AS name, ((s_suppkey*s_suppkey*13 + s_suppkey*6007 + 13) % 10007)::DOUBLE AS cx,
  ((s_suppkey*s_suppkey*7 + s_suppkey*3001 + s_nationkey*397 + 29) % 10009)::DOUBLE AS cy, CASE WHEN s_suppkey % 10 = 0 THEN 1200.0 ELSE 350.0 END::DOUBLE AS half, ([{_CODES}])[s_nationkey % 14 + 1] AS land_use FROM supplier""",
    "inside": """SELECT p.*, (SELECT min(a.aoi_id) FROM aoi a WHERE abs(p.x - a.cx) < a.half AND abs(p.y - a.cy) < a.half) AS aoi_id FROM poi p""",
    "attached": "SELECT * FROM inside WHERE aoi_id IS NOT NULL",
    "road": "SELECT p_partkey AS road_id, p_name AS name FROM part",
    "street": "SELECT p_partkey AS road_id, concat(p_name, ' ', p_partkey % 40) AS name FROM part",
    "lane": "SELECT l_orderkey AS junction_id, l_partkey AS road_id, l_suppkey AS aoi_id, l_linenumber::BIGINT AS no, l_quantity*20 AS length FROM lineitem",
    "lanes": """SELECT *, road_id*1000000 + k AS lane_id, ((junction_id*junction_id*13 + junction_id*6007) % 10007)::DOUBLE AS x, ((junction_id*junction_id*7 + junction_id*3001) % 10009)::DOUBLE AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY junction_id, no, aoi_id, length) AS k FROM lane)""",
    "edge": """SELECT DISTINCT b.junction_id, way, CASE way WHEN 'in' THEN a.lane_id ELSE b.lane_id END AS lane_id FROM lanes a JOIN lanes b ON b.road_id = a.road_id AND b.k = a.k + 1, (VALUES ('in'), ('out')) w(way) WHERE (a.road_id + a.k) % 4 < 2""",
    "lane_side": """SELECT e.lane_id, CASE e.way WHEN 'out' THEN 'predecessor' ELSE 'successor' END AS side, e.junction_id, coalesce(names, []) AS names, c.x, c.y FROM edge e
  LEFT JOIN (SELECT edge.junction_id, way, list_sort(list(DISTINCT r.name)) AS names FROM edge JOIN lanes USING (lane_id) JOIN road r USING (road_id) GROUP BY edge.junction_id, way) n ON n.junction_id = e.junction_id AND n.way <> e.way
  JOIN (SELECT junction_id, avg(x) AS x, avg(y) AS y FROM (SELECT DISTINCT edge.junction_id, lane_id, x, y FROM edge JOIN lanes USING (lane_id)) GROUP BY 1) c ON c.junction_id = e.junction_id""",
    "step": f"""SELECT junction_id AS route_id, no, road_id, aoi_id, r.name AS road_name, floor(length)::BIGINT AS road_length, ([{_DIR8}])[aoi_id % 8 + 1] AS direction FROM lane JOIN road r USING (road_id)""",
    "ends": "SELECT o_orderkey AS route_id, o_custkey AS start_id, (o_custkey*31 + o_orderkey) % (SELECT count(*) FROM customer) AS dest_id FROM orders",
    "visit": """SELECT concat(user_id, '_', strftime(ts, '%Y%m%d')) AS traj_id, user_id, event_id, ts, event_type, k AS loc_id, CASE WHEN user_id % 2 = 0 THEN 'real' ELSE 'generated' END AS kind,
  least(value, 1440.0)/1440 AS duration, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS seq, ((k*k*31 + k*7919) % 10007)::DOUBLE AS x, ((k*k*17 + k*4729) % 10009)::DOUBLE AS y
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k FROM events)""",
    "output": """SELECT user_id % 4 AS model, event_type AS task, event_id,
  CASE WHEN event_id % 11 IN (3, 5, 6, 10) THEN 'Z' ELSE s END AS said, substr('ABCD', (event_id % 4 + 1)::INT, 1) AS answer FROM (SELECT *, substr('ABCDE', (event_id % 5 + 1)::INT, 1) AS s FROM events)""",
    "dialogue": "SELECT conv_id, turn, role, text FROM conversations",
    "sft": "SELECT doc_id, text, lang, source AS data_source FROM documents",
}
USES = {"lanes": ("lane",), "edge": ("lane", "lanes"), "lane_side": ("lane", "lanes", "edge", "road"), "inside": ("poi", "aoi"), "attached": ("poi", "aoi", "inside"), "step": ("lane", "road"), "ends": ()}


def with_views(sql: str) -> str:
    """The statement with the views it names put in front."""
    import re

    named = set(re.findall(r"\b[a-z_]+\b", sql))
    wanted = (named & set(VIEWS)) | {u for v in named & set(USES) for u in USES[v]}
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted)
    sql = sql.strip()
    if not views:
        return sql
    if sql[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {views}, {sql[14:]}"
    return f"WITH {views}, {sql[4:]}" if sql[:5].upper() in ("WITH ", "WITH\n") else f"WITH {views} {sql}"


def coord_sql(lng: str, lat: str) -> str:
    """The SQL twin of functions.geo.coord_text."""
    one = "concat(floor({0} * 10000 + 0.5)::BIGINT // 10000, '.', lpad((floor({0} * 10000 + 0.5)::BIGINT % 10000)::VARCHAR, 4, '0'))"
    return f"concat({one.format(f'({lng})')}, ', ', {one.format(f'({lat})')})"


def md5_sql(*parts: str, seed: int = 0) -> str:
    """The SQL twin of functions.text.keyed."""
    return f"md5(concat_ws('#', {', '.join(parts)}, '{seed}'))"


def number_sql(n: int | str, *parts: str, seed: int = 0) -> str:
    return f"(('0x' || substr({md5_sql(*parts, seed=seed)}, 1, 8))::BIGINT % {n})"
