"""Routes: arrays of steps (type, road_name, road_length, direction, junc_name)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = "array<struct<type:string,road_name:string,road_length:bigint,direction:string,junc_name:string>>"
PRIMARY = ("north", "east", "south", "west")
#: Share of a diagonal stretch that counts for each of its two primary directions.
DIAGONAL = 0.7


def parse_route(text: Column) -> Column:
    return F.from_json(text, STEPS)


def step_phrase(s: Column) -> Column:
    road = F.concat(F.lit("walk along "), s["road_name"], F.lit(" for "), s["road_length"].cast("string"), F.lit(" meters "), s["direction"])
    return F.when(s["type"] == "road", road).otherwise(F.concat(F.lit("then go to "), s["junc_name"]))


def route_phrases(routes: Column) -> Column:
    return F.transform(routes, step_phrase)


def route_text(routes: Column) -> Column:
    return F.array_join(route_phrases(routes), ", ")


def short_route(routes: Column, most: int = 12) -> Column:
    """Not empty and at most `most` road steps, junctions standing between roads."""
    return (F.size(routes) > 0) & ((F.size(routes) + 1) / 2 <= most)


def direction_totals(routes: Column) -> Column:
    """Metres by primary direction (last word of a step's direction); diagonal
    stretches count 0.7 for both of theirs."""
    start = F.struct(*(F.lit(0.0).alias(d) for d in PRIMARY))

    def step(acc, s):
        word, metres = F.element_at(F.split(s["direction"], " "), -1), s["road_length"].cast("double")
        share = lambda d: F.when((s["type"] != "road") | ~word.contains(d), 0.0).when(word == d, metres).otherwise(metres * DIAGONAL)
        return F.struct(*((acc[d] + share(d)).alias(d) for d in PRIMARY))

    return F.aggregate(routes, start, step)


def net_direction(totals: Column) -> tuple[Column, Column, Column, Column]:
    """Net east and north metres, the dominant axis and the overall direction; the
    last two are null where both axes tie."""
    east, north = totals["east"] - totals["west"], totals["north"] - totals["south"]
    axis = F.when(F.abs(east) > F.abs(north), F.lit("east-west")).when(F.abs(north) > F.abs(east), F.lit("south-north"))
    main = F.when(axis == "east-west", F.when(east > 0, F.lit("east")).otherwise(F.lit("west"))).when(axis == "south-north", F.when(north > 0, F.lit("north")).otherwise(F.lit("south")))
    return east, north, axis, main
