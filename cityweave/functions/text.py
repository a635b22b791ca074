"""Text, JSON and message-list column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-use codes and their names; the evaluation jobs know all but B1.
LAND_USE = {
    "E3": "OtherNon-construction", "R": "Residential", "S4": "TrafficStation&Park", "A4": "Sports", "B31": "Entertainment", "B1": "CommercialFacilities",
    "U9": "OtherPublicFacilities", "A3": "Education", "G1": "Park&GreenLand", "B": "CommercialService&IndustryFacilities", "B32": "Resort&Fitness",
    "B13": "Restaurant&Bar", "A9": "ReligiousFacilities", "A5": "Hospital",
}
EVAL_LAND_USE = {code: name for code, name in LAND_USE.items() if code != "B1"}
CODES = tuple(LAND_USE)
# The four ways in which an answer letter is given, tried in this order:
# "answer is A", "choose A" (not "answer is not A"); "A is correct" (not "A isn't right");
# a text that starts with the letter; a line that does.
CHOICE_PATTERNS = (
    r"(?:(?:[Cc]hoose)|(?:(?:[Aa]nswer|[Cc]hoice)(?![^A-H]{0,20}?(?:n't|not))[^A-H]{0,10}?\b(?:|is|:|be))\b)[^A-H]{0,20}?\b([A-H])\b",
    r"\b([A-H])\b(?![^A-H]{0,8}?(?:n't|not)[^A-H]{0,5}?(?:correct|right))[^A-H]{0,10}?\b(?:correct|right)\b",
    r"^([A-H])(?:\.|,|:|$)",
    r"\n\s*([A-H])",
)


def top_category(category: Column) -> Column:
    return F.element_at(F.split(category, " > "), 1)


def join_labels(labels: Column) -> Column:
    return F.coalesce(F.array_join(labels, "|"), F.lit(""))


def landuse_name(code: Column, names: dict[str, str] = LAND_USE) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)


def address_text(side: Column, road: Column, offset: Column, toward: Column, junction: Column, inside: Column) -> Column:
    """The address sentence; the last part only where an area is given."""
    text = F.concat(side, F.lit(" side of "), road, F.lit(", "), offset, F.lit(" to the "), toward, F.lit(" of the junction with "), junction)
    return F.concat(text, F.when(F.coalesce(inside, F.lit("")) != "", F.concat(F.lit(", inside "), inside)).otherwise(F.lit("")))


ADDRESS = r"^(\w+) side of (.+?), (within 50m|\d+m) to the (\w+) of the junction with (.+?)(?:, inside (.+))?$"


def parse_address(text: Column, inside: bool = True) -> Column:
    """The sentence's elements as a struct; null where it does not match (or has no
    area though one is asked for)."""
    part = lambda i: F.regexp_extract(text, ADDRESS, i)
    names = ("side", "road", "offset", "toward", "junction", *(("inside",) if inside else ()))
    ok = text.rlike(ADDRESS) & ((part(6) != "") if inside else F.lit(True))
    return F.when(ok, F.struct(*(part(i + 1).alias(n) for i, n in enumerate(names))))


def address_from_json(text: Column, exclude: tuple[str, ...] = ("postcode", "country")) -> Column:
    """Values of a JSON object but for two keys, joined; "invalid" for no object."""
    values = F.map_values(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: ~k.isin(*exclude)))
    return F.coalesce(F.array_join(values, ", "), F.lit("invalid"))


def route_length(text: Column) -> Column:
    """Sum of the numbers in "for N meters"."""
    found = F.regexp_extract_all(text, F.lit(r"for (\d+) meters"), 1)
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def task_type(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"-(\w+)-\d+$", 1)


def extract_choice(text: Column, default: str = "Z") -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in CHOICE_PATTERNS]
    return F.coalesce(*found, F.lit(default))


def parse_final_answer(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"Final Answer:\s*([^\n]*)", 1))


def split_reasoning(text: Column) -> tuple[Column, Column]:
    """(answer, reasoning) around the mark "Reasoning:"."""
    p = F.split(text, "Reasoning:", 2)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    answer = strip(F.regexp_replace(F.element_at(p, 1), r"^\s*Answer:?", ""))
    return answer, strip(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")))


def first_int(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("long"), F.lit(-1).cast("long"))


def longest_int(text: Column) -> Column:
    """The longest run of digits (the first of equals) as a number; -1 for none."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    best = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.coalesce(best.try_cast("long"), F.lit(-1).cast("long"))


def parse_score(text: Column, tags: tuple[str, ...] = ("Score:", "score", "**")) -> Column:
    out = text
    for tag in tags:
        out = F.replace(out, F.lit(tag), F.lit(""))
    return F.trim(out).try_cast("double")


def keyed(*parts: Column | str, seed: int = 0) -> Column:
    """The md5 that stands for a random draw: md5 of parts and seed joined by '#'."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("#", *columns, F.lit(str(seed))))


def keyed_number(n: int, *parts: Column | str, seed: int = 0) -> Column:
    return F.pmod(F.conv(F.substring(keyed(*parts, seed=seed), 1, 8), 16, 10).cast("long"), F.lit(n))


def fill_template(key: Column, templates: list[str], slots: dict[str, Column], seed: int = 0) -> Column:
    """One of the phrasings, chosen by the key's hash, with {slot} marks filled."""
    text = F.element_at(F.array(*map(F.lit, templates)), (keyed_number(len(templates), key, seed=seed) + 1).cast("int"))
    for name, value in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def sum_chain_text(values: Column) -> tuple[Column, Column]:
    """"a+b=s, s+c=t" and the total."""
    longs = F.transform(values, lambda v: v.cast("long"))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("long").alias("sum"))

    def step(acc, v):
        piece = F.concat(acc["sum"].cast("string"), F.lit("+"), v.cast("string"), F.lit("="), (acc["sum"] + v).cast("string"))
        text = F.when(acc["sum"].isNull(), F.lit("")).when(acc["text"] == "", piece).otherwise(F.concat(acc["text"], F.lit(", "), piece))
        return F.struct(text.alias("text"), (F.coalesce(acc["sum"], F.lit(0).cast("long")) + v).alias("sum"))

    return F.aggregate(longs, start, step, lambda a: a["text"]), F.aggregate(longs, start, step, lambda a: a["sum"])


def bio_components(tokens: Column, tags: Column) -> Column:
    """Runs of B/I/E tagged tokens as an array of (kind, text); O ends a run."""
    item = "array<struct<kind:string,text:string>>"
    start = F.struct(F.array().cast(item).alias("done"), F.lit("").alias("kind"), F.lit("").alias("text"))

    def flushed(acc):
        return F.when(acc["kind"] != "", F.concat(acc["done"], F.array(F.struct(acc["kind"].alias("kind"), acc["text"].alias("text"))))).otherwise(acc["done"])

    def step(acc, z):
        mark, kind = F.substring(z["tag"], 1, 1), F.substring(z["tag"], 3, 100)
        goes_on = mark.isin("I", "E") & (kind == acc["kind"])
        opens = mark.isin("B", "I", "E")
        return F.struct(
            F.when(goes_on, acc["done"]).otherwise(flushed(acc)).alias("done"),
            F.when(opens, kind).otherwise(F.lit("")).alias("kind"),
            F.when(goes_on, F.concat(acc["text"], z["token"])).when(opens, z["token"]).otherwise(F.lit("")).alias("text"),
        )

    zipped = F.arrays_zip(tokens.alias("token"), tags.alias("tag"))
    zipped = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.struct(F.element_at(tokens, i).alias("token"), F.element_at(tags, i).alias("tag")))
    return F.when(F.size(tokens) > 0, F.aggregate(zipped, start, step, flushed)).otherwise(F.array().cast(item))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter(index: Column) -> Column:
    """The letter of a place counted from 0."""
    return F.substring(F.lit(LETTERS), (index + 1).cast("int"), F.lit(1))


def mcq_prompt(question: Column, options: Column, prefix: str = "", suffix: str = "Answer:") -> Column:
    lines = F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o))
    return F.concat(F.lit(prefix), question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n" + suffix if suffix else ""))
