"""Column functions over a model's answers: JSON in prose, lists, mappings, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_in(text: Column) -> Column:
    """The JSON text of an answer: a fenced block, the whole, the outermost braces, then brackets; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1)
    parts = [fenced, stripped(text), F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)]
    sound = lambda t: F.when((stripped(t) != "") & F.try_parse_json(t).isNotNull(), stripped(t))
    return F.coalesce(*map(sound, parts))


def json_object(text: Column, forbidden: tuple[str, ...] = ()) -> Column:
    """The JSON text of an answer that is an object without forbidden keys, else null."""
    found = stripped(F.regexp_replace(stripped(text), r"^```(?:json|JSON)?\s*|\s*```$", ""))
    keys = F.json_object_keys(F.when(F.try_parse_json(found).isNotNull() & found.startswith("{"), found))
    return F.when(keys.isNotNull() & ~F.arrays_overlap(keys, F.array(*map(F.lit, forbidden)).cast("array<string>")), found)


def text_list(answer: Column, length: Column | None = None) -> Column:
    """Trimmed texts of a JSON list without blank ones; null unless it has ``length`` of them where that is asked."""
    found = F.filter(F.transform(F.from_json(answer, "array<string>"), stripped), lambda t: t != "")
    return found if length is None else F.when(F.size(found) == length, found)


def text_mapping(answer: Column) -> Column:
    """A map of "row,col" to text from a JSON object with keys "row,col" or "row:col"; null unless all are so and filled."""
    found = F.from_json(answer, "map<string,string>")
    sound = F.forall(F.map_entries(found), lambda e: e["key"].rlike(r"^\s*\d+\s*[,:]\s*\d+\s*$") & (stripped(F.coalesce(e["value"], F.lit(""))) != ""))
    key = lambda k: F.regexp_replace(F.regexp_replace(k, r"\s", ""), ":", ",")
    listed = F.transform(F.map_entries(found), lambda e: F.struct(key(e["key"]).alias("key"), stripped(e["value"]).alias("value")))
    return F.when((F.size(listed) > 0) & sound & (F.size(F.array_distinct(listed["key"])) == F.size(listed)), F.map_from_entries(listed))


def unit_score(text: Column) -> Column:
    """A score of a judge, brought into 0 to 1; null where it is no finite number."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def topic_plan(answer: Column) -> Column:
    """struct(topic, scenario, min_rows, max_rows, min_cols, max_cols) of a model's answer: an object, or a bare text as the topic.

    Null without a topic.
    """
    found = json_object(answer)
    kind = "struct<topic:string,semantic_scenario:string,min_rows:int,max_rows:int,min_cols:int,max_cols:int>"
    read = F.from_json(found, kind)
    bare = F.when(found.isNull() & ~stripped(answer).startswith("{"), F.regexp_replace(stripped(answer), r'^"|"$', ""))
    topic = F.nullif(stripped(F.coalesce(read["topic"], bare, F.lit(""))), F.lit(""))
    rest = [read[k].alias(k) for k in ("min_rows", "max_rows", "min_cols", "max_cols")]
    return F.when(topic.isNotNull(), F.struct(topic.alias("topic"), F.nullif(stripped(F.coalesce(read["semantic_scenario"], F.lit(""))), F.lit("")).alias("scenario"), *rest))


# What a template without these fields gets.
TEMPLATE_DOMAIN, TEMPLATE_SCENARIO, TEMPLATE_TOPIC = "general", "custom_scenario", "数据汇总表"


def templates(answer: Column, domain: Column | None = None) -> Column:
    """array of struct(domain, scenario, topic, headers, group_headers, row_headers) of an answer with templates.

    A fence around it is taken off; where the whole does not parse, the outermost brackets are read; one object counts as a
    list of one.  Templates without headers are dropped.  ``domain`` takes the place of any other domain.
    """
    text = stripped(answer)
    text = F.when(text.startswith("```"), stripped(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"```$", ""))).otherwise(text)
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    sound = lambda t: F.when((t != "") & F.try_parse_json(t).isNotNull(), t)
    found = F.coalesce(sound(text), sound(inner))
    listed = F.when(found.startswith("{"), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found)
    one = "struct<domain:string,semantic_scenario:string,topic:string,headers:array<string>,group_headers:array<string>,row_headers:array<string>>"
    read = F.filter(F.from_json(listed, f"array<{one}>"), lambda x: F.coalesce(F.size(x["headers"]), F.lit(0)) > 0)
    texts = lambda a: F.transform(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")), stripped)
    named = lambda x: domain if domain is not None else F.coalesce(x["domain"], F.lit(TEMPLATE_DOMAIN))
    made = lambda x: F.struct(named(x).alias("domain"), F.coalesce(x["semantic_scenario"], F.lit(TEMPLATE_SCENARIO)).alias("scenario"), F.coalesce(x["topic"], F.lit(TEMPLATE_TOPIC)).alias("topic"), texts(x["headers"]).alias("headers"), texts(x["group_headers"]).alias("group_headers"), texts(x["row_headers"]).alias("row_headers"))
    return F.coalesce(F.transform(read, made), F.array().cast(f"array<{one.replace('semantic_scenario', 'scenario')}>"))


#: Fields of a request that a plan may change, by kind.
REQUEST_TEXTS, REQUEST_BOUNDS, REQUEST_FLAGS = ("domain", "language", "structure_type"), ("min_rows", "max_rows", "min_cols", "max_cols"), ("simple", "colored", "lined")


def planned_request(proposed: Column) -> Column:
    """struct of the fields of a request and error: the request's columns, changed as the JSON object ``proposed`` says.

    Fields that are not known are ignored.  Bounds must be whole numbers (a text of one counts, a boolean does not), at least
    1 and in order; flags must be boolean or null.  Where anything is wrong, or ``proposed`` is no object, the request stays
    as it is and ``error`` says why.
    """
    held = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(proposed)).startswith("OBJECT"), F.lit(False)), F.try_parse_json(proposed))
    keys = F.coalesce(F.json_object_keys(F.when(held.isNotNull(), proposed)), F.array().cast("array<string>"))
    given = lambda k: F.array_contains(keys, F.lit(k))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(held, f"$.{k}", "variant"))
    text = lambda k: F.try_variant_get(held, f"$.{k}", "string")
    whole = lambda k: F.coalesce(F.when(kind(k).startswith("STRING"), F.when(stripped(text(k)).rlike(r"^[+-]?\d+$"), stripped(text(k)).try_cast("int"))).otherwise(F.try_variant_get(held, f"$.{k}", "double").try_cast("int")), F.lit(None).cast("int"))
    new = {k: F.when(given(k), text(k)).otherwise(F.col(k)) for k in REQUEST_TEXTS}
    new |= {k: F.when(given(k), whole(k)).otherwise(F.col(k)) for k in REQUEST_BOUNDS}
    new |= {k: F.when(given(k), F.try_variant_get(held, f"$.{k}", "boolean")).otherwise(F.col(k)) for k in REQUEST_FLAGS}
    error = F.when(held.isNull(), "Core Planner returned invalid JSON")
    for k in REQUEST_BOUNDS:
        error = error.when(given(k) & (kind(k) == "BOOLEAN"), f"{k} must be an integer").when(given(k) & new[k].isNull(), f"{k} must be an integer")
    for low, high, name in (("min_rows", "max_rows", "row"), ("min_cols", "max_cols", "column")):
        error = error.when((new[low] < 1) | (new[low] > new[high]), f"invalid {name} bounds from Core Planner")
    for k in REQUEST_FLAGS:
        error = error.when(given(k) & ~kind(k).isin("BOOLEAN", "VOID"), f"{k} must be boolean or null")
    return F.struct(*[F.when(error.isNull(), v).otherwise(F.col(k)).alias(k) for k, v in new.items()], error.alias("error"))
