"""JSON-LD as VARIANT expressions: row-local, any nesting depth, no shuffle."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<variant>"


def _empty(ddl: str) -> Column:
    return F.array().cast(ddl)


def parse_json_strict(text: Column) -> Column:
    """VARIANT of a whole JSON text, NULL if malformed.

    The parser stops after the first value, so trailing text is ruled out by wrapping it twice.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(in_array, "$", NODES)) == 1
    return F.when(alone & in_object.isNotNull(), F.try_variant_get(in_array, "$[0]", "variant"))


def json_depth(text: Column) -> Column:
    """Deepest nesting of a JSON text, from its brackets outside strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.regexp_extract_all(bare, F.lit(r"([\[{\]}])"), F.lit(1))
    top = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("level"), F.lit(0).alias("top")),
        lambda acc, b: F.struct(
            (acc.level + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("level"),
            F.greatest(acc.top, acc.level + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("top"),
        ),
        lambda acc: acc.top,
    )
    return F.coalesce(top, F.lit(0))


def as_array(node: Column) -> Column:
    return F.try_variant_get(node, "$", NODES)


def as_map(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>")


def kind_of(node: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def string_of(node: Column) -> Column:
    """The text of a JSON string, NULL for any other value."""
    return F.when(kind_of(node) == "STRING", F.try_variant_get(node, "$", "string"))


def truthy(node: Column) -> Column:
    kind = kind_of(node)
    value = (
        F.when(kind == "STRING", F.try_variant_get(node, "$", "string") != "")
        .when(kind == "BOOLEAN", F.try_variant_get(node, "$", "boolean"))
        .when(kind == "OBJECT", F.size(as_map(node)) > 0)
        .when(kind == "ARRAY", F.size(as_array(node)) > 0)
        .when(kind == "VOID", F.lit(False))
        .otherwise(F.try_variant_get(node, "$", "double") != 0)
    )
    return F.coalesce(value, F.lit(False))


def descend(
    roots: Column, depth: Column, children: Callable, emit: Callable, out_ddl: str, node_ddl: str = NODES
) -> Column:
    """Breadth-first walk, one level per step, `depth` levels: the concatenated emissions of all nodes."""
    start = F.struct(roots.cast(node_ddl).alias("nodes"), _empty(out_ddl).alias("out"))
    return F.aggregate(
        F.sequence(F.lit(0), depth),
        start,
        lambda acc, _: F.struct(
            F.flatten(F.transform(acc.nodes, children)).cast(node_ddl).alias("nodes"),
            F.concat(acc.out, F.flatten(F.transform(acc.nodes, emit)).cast(out_ddl)).alias("out"),
        ),
        lambda acc: acc.out,
    )


def _kids(node: Column, skip_type: Column) -> Column:
    entries = F.map_filter(as_map(node), lambda k, _: ~((k == "@type") & skip_type))
    return F.coalesce(as_array(node), F.map_values(entries), _empty(NODES))


def _type_names(node: Column) -> Column:
    value = F.try_element_at(as_map(node), F.lit("@type"))
    listed = F.filter(F.transform(as_array(value), string_of), lambda s: s.isNotNull())
    return F.coalesce(F.when(string_of(value).isNotNull(), F.array(string_of(value))), listed, _empty("array<string>"))


def schema_types(roots: Column, depth: Column) -> Column:
    """Every '@type' name at any depth, repeats kept."""
    return descend(roots, depth, lambda n: _kids(n, F.lit(True)), _type_names, "array<string>")


FAQ_DDL = "array<struct<question:string,answer:string>>"


def _answer_texts(node: Column) -> Column:
    none = _empty("array<string>")

    def text_of(n: Column) -> Column:
        text = string_of(F.try_element_at(as_map(n), F.lit("text")))
        return F.when(text != "", F.array(text)).otherwise(none)

    accepted = F.try_element_at(as_map(node), F.lit("acceptedAnswer"))
    plain = string_of(accepted)
    parts = (
        F.when(as_array(accepted).isNotNull(), F.flatten(F.transform(as_array(accepted), text_of)))
        .when(plain.isNotNull(), F.when(plain != "", F.array(plain)).otherwise(none))
        .otherwise(text_of(accepted))
    )
    return F.concat(F.coalesce(parts, none), text_of(node))


def faq_build(node: Column, depth: Column) -> Column:
    """Question and answer pairs of a node or of arbitrarily nested lists of nodes."""
    leaves = F.aggregate(
        F.sequence(F.lit(0), depth),
        F.array(node),
        lambda acc, _: F.flatten(F.transform(acc, lambda n: F.coalesce(as_array(n), F.array(n)))),
    )

    def item(n: Column) -> Column:
        fields = as_map(n)
        name = F.try_element_at(fields, F.lit("name"))
        has_answer = truthy(F.try_element_at(fields, F.lit("acceptedAnswer"))) | truthy(
            F.try_element_at(fields, F.lit("text"))
        )
        question = F.coalesce(string_of(name), F.to_json(name))
        pair = F.struct(question.alias("question"), F.array_join(_answer_texts(n), " ").alias("answer"))
        return F.when(truthy(name) & has_answer, pair)

    items = F.filter(F.transform(leaves, item), lambda x: x.isNotNull())
    return F.coalesce(items.cast(FAQ_DDL), _empty(FAQ_DDL))


def faq_items(roots: Column, depth: Column) -> Column:
    """FAQ pairs of every FAQPage node at any depth."""

    def is_faq(n: Column) -> Column:
        return F.array_contains(_type_names(n), "FAQPage")

    def emit(n: Column) -> Column:
        entity = F.try_element_at(as_map(n), F.lit("mainEntity"))
        return F.when(is_faq(n) & entity.isNotNull(), faq_build(entity, depth)).otherwise(_empty(FAQ_DDL))

    return descend(roots, depth, lambda n: _kids(n, is_faq(n)), emit, FAQ_DDL)


WALK_DDL = "array<struct<depth:int,path:string,key:string,value:variant>>"


def walk(root: Column, depth: Column) -> Column:
    """Every value inside a JSON document with its depth, path and key (NULL for list elements)."""

    def children(n: Column) -> Column:
        items = F.transform(
            as_array(n.value),
            lambda v, i: F.struct(
                (n.depth + 1).alias("depth"),
                F.concat(n.path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
                F.lit(None).cast("string").alias("key"),
                v.alias("value"),
            ),
        )
        fields = F.transform(
            F.map_entries(as_map(n.value)),
            lambda e: F.struct(
                (n.depth + 1).alias("depth"),
                F.concat(n.path, F.lit("."), e.key).alias("path"),
                e.key.alias("key"),
                e.value.alias("value"),
            ),
        )
        return F.coalesce(items.cast(WALK_DDL), fields.cast(WALK_DDL), _empty(WALK_DDL))

    first = F.array(
        F.struct(
            F.lit(0).alias("depth"),
            F.lit("$").alias("path"),
            F.lit(None).cast("string").alias("key"),
            root.alias("value"),
        )
    )
    return descend(first, depth, children, lambda n: F.array(n), WALK_DDL, WALK_DDL)
